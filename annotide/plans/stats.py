"""Counts, distributions, accuracy and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.dims import MINORISH
from annotide.operators.harmony import best_chords
from annotide.operators.temporal import near_join, top_k
from annotide.plans.joins import track_polyphony
from annotide.plans.registry import query
from annotide.plans.windows import CHORDS_SQL, MASKS_SQL, grid_masks
from annotide.sources.notes import NOTES_SQL, notes, table


def pitch_class() -> Column:
    return F.pmod("midi", F.lit(12))


BIGRAM_SQL = f"""{NOTES_SQL}, l AS (SELECT song_id, note_id, start_ms, track, midi % 12 AS pc, lag(track) OVER w AS pt, lag(midi % 12) OVER w AS pp FROM n WINDOW w AS (PARTITION BY song_id ORDER BY start_ms, note_id)),
c AS (SELECT * FROM l WHERE NOT (track IS NOT DISTINCT FROM pt AND pc IS NOT DISTINCT FROM pp)),
b AS (SELECT track AS q_from, lead(track) OVER w AS q_to, (lead(pc) OVER w - pc + 12) % 12 AS dr FROM c WINDOW w AS (PARTITION BY song_id ORDER BY start_ms, note_id)),
k AS (SELECT q_from, dr, q_to, count(*) AS n FROM b WHERE q_to IS NOT NULL GROUP BY ALL)"""


def bigrams(n: DataFrame) -> DataFrame:
    """q_from, dr, q_to, n: steps between neighbours that differ, whatever pitch they start from."""
    w = Window.partitionBy("song_id").orderBy("start_ms", "note_id")
    token = F.struct(F.col("track"), pitch_class().alias("pc"))
    t = n.select("song_id", "start_ms", "note_id", token.alias("tok"))
    t = t.withColumn("prev", F.lag("tok").over(w)).where(~F.col("tok").eqNullSafe(F.col("prev")))
    t = t.withColumn("next", F.lead("tok").over(w)).where("next is not null")
    return t.groupBy(F.col("tok.track").alias("q_from"), F.pmod(F.col("next.pc") - F.col("tok.pc"), F.lit(12)).alias("dr"), F.col("next.track").alias("q_to")).agg(F.count("*").alias("n"))


@query(f"""WITH {BIGRAM_SQL}, q AS (SELECT DISTINCT track AS q FROM n), d AS (SELECT a.q AS q_from, dr, b.q AS q_to FROM q a, q b, (SELECT unnest(generate_series(0, 11)) AS dr))
SELECT d.q_from, CAST(d.dr AS INTEGER) AS dr, d.q_to, coalesce(k.n, 0) AS n, round(ln((coalesce(k.n, 0) + 1)::DOUBLE / CAST(sum(coalesce(k.n, 0) + 1) OVER (PARTITION BY d.q_from) AS DOUBLE)), 6) AS logp FROM d LEFT JOIN k ON k.q_from = d.q_from AND k.dr = d.dr AND k.q_to = d.q_to""")
def bigram_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-one smoothed transition log-probabilities, dense over the vocabulary of labels."""
    n = notes(spark, sf_dir)
    vocabulary = n.agg(F.collect_set("track").alias("v"))  # labels, not rows
    cells = vocabulary.select(F.explode("v").alias("q_from"), "v").repartition("q_from").select("q_from", F.explode("v").alias("q_to")).select("q_from", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("dr"), "q_to")
    dense = cells.join(bigrams(n), ["q_from", "dr", "q_to"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = F.sum(F.col("n") + 1).over(Window.partitionBy("q_from"))
    return dense.withColumn("logp", F.round(F.log((F.col("n") + 1).cast("double") / total.cast("double")), 6))


@query(f"WITH {BIGRAM_SQL} SELECT q_from, CAST(dr AS INTEGER) AS dr, q_to, n FROM k ORDER BY n DESC, q_from, dr, q_to LIMIT 12")
def top_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigrams(notes(spark, sf_dir)).orderBy(F.col("n").desc(), "q_from", "dr", "q_to").limit(12)


@query(f"""WITH {NOTES_SQL}, i AS (SELECT song_id, start_ms - lag(start_ms) OVER (PARTITION BY song_id ORDER BY start_ms, note_id) AS ioi FROM n)
SELECT song_id, CAST(least((ioi - 150) * 60 // 1050, 59) AS INTEGER) AS bin, count(*) AS n FROM i WHERE ioi BETWEEN 150 AND 1200 GROUP BY ALL""")
def ioi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times between onsets in 60 bins from 150 to 1200 ms; the last bin is closed."""
    w = Window.partitionBy("song_id").orderBy("start_ms", "note_id")
    i = notes(spark, sf_dir).withColumn("ioi", F.col("start_ms") - F.lag("start_ms").over(w)).where("ioi between 150 and 1200")
    return i.groupBy("song_id", F.least(F.expr("(ioi - 150) * 60 div 1050"), F.lit(59)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {NOTES_SQL}, b AS (SELECT song_id, start_ms // 500 AS i, sum(amp) AS novelty, sum(CASE WHEN midi < 48 THEN amp ELSE 0 END) AS bass FROM n GROUP BY ALL)
SELECT song_id, CAST(i % 4 AS INTEGER) AS phase, round(avg(novelty) + 0.6 * avg(bass), 6) AS score FROM b GROUP BY ALL""")
def phase_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean onset strength, and 0.6 of the bass's, of each residue class of beats."""
    n = notes(spark, sf_dir)
    b = n.groupBy("song_id", F.expr("start_ms div 500").alias("i")).agg(F.sum("amp").alias("novelty"), F.sum(F.when(F.col("midi") < 48, F.col("amp")).otherwise(0)).alias("bass"))
    return b.groupBy("song_id", (F.col("i") % 4).cast("int").alias("phase")).agg(F.round(F.avg("novelty") + 0.6 * F.avg("bass"), 6).alias("score"))


ROLES_SQL = f"""{NOTES_SQL}, pc AS (SELECT a.song_id, a.track, a.note_id, count(b.note_id) AS c FROM n a LEFT JOIN n b ON a.song_id = b.song_id AND a.track = b.track AND b.start_ms <= a.start_ms + 20 AND a.start_ms + 20 < b.end_ms GROUP BY ALL),
po AS (SELECT song_id, track, CASE WHEN count(*) < 4 THEN 1.0 ELSE round(sum(c)::DOUBLE / count(*), 9) END AS polyphony FROM pc GROUP BY ALL),
st AS (SELECT song_id, track, count(*) AS notes, median(midi) AS med, min(midi) AS low, max(midi) AS high FROM n GROUP BY ALL),
ro AS (SELECT st.*, polyphony, CASE WHEN regexp_matches(track, 'err|drum') THEN 'drums' WHEN med < 50 AND polyphony < 2 THEN 'bass' WHEN polyphony >= 1.5 THEN 'harmony' WHEN med >= 55 THEN 'melody' ELSE 'other' END AS role FROM st JOIN po USING (song_id, track))"""


def roles(n: DataFrame) -> DataFrame:
    stats = n.groupBy("song_id", "track").agg(F.median("midi").alias("med"), F.min("midi").alias("low"), F.max("midi").alias("high"))
    r = track_polyphony(n).select("song_id", "track", "notes", "polyphony").join(stats, ["song_id", "track"])
    role = F.when(F.col("track").rlike("err|drum"), "drums").when((F.col("med") < 50) & (F.col("polyphony") < 2), "bass").when(F.col("polyphony") >= 1.5, "harmony").when(F.col("med") >= 55, "melody").otherwise("other")
    return r.withColumn("role", role)


@query(f"WITH {ROLES_SQL} SELECT song_id, track, notes, med, low, high, polyphony, role FROM ro")
def track_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a track is, by its name, register and polyphony."""
    return roles(notes(spark, sf_dir))


@query(f"""WITH {ROLES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY CASE WHEN regexp_matches(track, 'view|voc') THEN 0 WHEN regexp_matches(track, 'click|lead') THEN 1 ELSE 2 END, notes DESC, track) AS rn,
 sum(CASE WHEN role = 'harmony' THEN 1 ELSE 0 END) OVER (PARTITION BY song_id) AS harm FROM ro)
SELECT song_id, max(CASE WHEN rn = 1 THEN track END) AS melody, string_agg(CASE WHEN role = 'harmony' OR (harm <= 1 AND rn > 1 AND role IN ('melody', 'other')) THEN track END, ',' ORDER BY track) AS pool FROM p GROUP BY song_id""")
def melody_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The melody track by name, then by size; with one harmony track or none the unused ones join the pool."""
    w = Window.partitionBy("song_id")
    first = F.when(F.col("track").rlike("view|voc"), 0).when(F.col("track").rlike("click|lead"), 1).otherwise(2)
    p = roles(notes(spark, sf_dir)).withColumn("rn", F.row_number().over(w.orderBy(first, F.col("notes").desc(), "track"))).withColumn("harm", F.sum((F.col("role") == "harmony").cast("int")).over(w))
    pooled = (F.col("role") == "harmony") | ((F.col("harm") <= 1) & (F.col("rn") > 1) & F.col("role").isin("melody", "other"))
    names = F.array_sort(F.collect_list(F.when(pooled, F.col("track"))))
    return p.groupBy("song_id").agg(F.max(F.when(F.col("rn") == 1, F.col("track"))).alias("melody"), F.when(F.size(names) > 0, F.array_join(names, ",")).alias("pool"))


@query(f"""WITH {NOTES_SQL}, c AS (SELECT song_id, start_ms // 5000 AS slice, midi % 12 AS pc, count(*) AS k, avg(amp) AS conf FROM n GROUP BY ALL),
r AS (SELECT *, sum(k) OVER (PARTITION BY song_id, slice) AS total, row_number() OVER (PARTITION BY song_id, slice ORDER BY k DESC, pc) AS rn FROM c)
SELECT song_id, slice, CASE WHEN k::DOUBLE / total >= 0.25 AND conf > 35 THEN pc END AS bass_pc, round(k::DOUBLE / total, 6) AS stability FROM r WHERE rn = 1""")
def modal_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent pitch class of each slice, if it is stable and loud enough; ties take the lowest."""
    c = notes(spark, sf_dir).groupBy("song_id", F.expr("start_ms div 5000").alias("slice"), pitch_class().alias("pc")).agg(F.count("*").alias("k"), F.avg("amp").alias("conf"))
    c = c.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("song_id", "slice")))
    best = top_k(c, ["song_id", "slice"], [F.col("k").desc(), F.col("pc")], 1)
    return best.select("song_id", "slice", F.when((F.col("share") >= 0.25) & (F.col("conf") > 35), F.col("pc")).alias("bass_pc"), F.round("share", 6).alias("stability"))


def family(sfx: Column) -> Column:
    return F.when(sfx.contains("sus"), "sus").when(sfx.isin(MINORISH), "min").otherwise("maj")


FAMILY = "CASE WHEN {0} LIKE '%sus%' THEN 'sus' WHEN {0} IN (" + ", ".join(f"'{m}'" for m in MINORISH) + ") THEN 'min' ELSE 'maj' END"


@query(f"""WITH {MASKS_SQL}, {CHORDS_SQL.replace("PENALTY", "1.5")}, e AS (SELECT h.song_id, h.t, h.mask, rk.root, rk.sfx FROM hits h JOIN rk ON rk.mask = h.mask AND rank = 1),
p AS (SELECT e.song_id, e.root = g.root AS r, e.root = g.root AND {FAMILY.format("e.sfx")} = {FAMILY.format("g.sfx")} AS f, e.root = g.root AND e.sfx = g.sfx AS x,
  4 * bit_count(e.mask & g.mask) >= 3 * bit_count(e.mask) AS c, EXISTS (SELECT 1 FROM rk a WHERE a.mask = e.mask AND a.rank <= 5 AND a.root = g.root) AS alt FROM e JOIN e g ON g.song_id = e.song_id AND g.t = e.t + 1000)
SELECT song_id, count(*) AS frames, round(avg(r::INT), 6) AS root, round(avg(f::INT), 6) AS family, round(avg(x::INT), 6) AS exact, round(avg(c::INT), 6) AS compat, round(avg(alt::INT), 6) AS in_alts FROM p GROUP BY song_id""")
def accuracy_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an estimate (each frame's chord) agrees with a truth (the next frame's): by root, by root and family,
    exactly, by shared tones, and by root among the alternatives."""
    m = grid_masks(notes(spark, sf_dir)).where("mask is not null")
    c = best_chords(m, 5, how="inner").groupBy("song_id", "t", "mask").agg(F.min_by(F.struct("root", "sfx"), "rank").alias("c"), F.collect_set("root").alias("roots"))
    truth = c.select("song_id", (F.col("t") - 1000).alias("t"), F.col("mask").alias("g_mask"), F.col("c").alias("g"))
    p = c.join(truth, ["song_id", "t"])
    root = F.col("c.root") == F.col("g.root")
    share = lambda b: F.round(F.avg(b.cast("int")), 6)
    return p.groupBy("song_id").agg(
        F.count("*").alias("frames"),
        share(root).alias("root"),
        share(root & (family(F.col("c.sfx")) == family(F.col("g.sfx")))).alias("family"),
        share(root & (F.col("c.sfx") == F.col("g.sfx"))).alias("exact"),
        share(4 * F.bit_count(F.col("mask").bitwiseAND(F.col("g_mask"))) >= 3 * F.bit_count("mask")).alias("compat"),
        share(F.array_contains("roots", F.col("g.root"))).alias("in_alts"),
    )


@query(f"""WITH {NOTES_SQL}, a AS (SELECT DISTINCT song_id, start_ms FROM n WHERE track = 'click'), b AS (SELECT DISTINCT song_id, start_ms FROM n WHERE track = 'view'),
x AS (SELECT song_id, count(*) AS est, sum(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.song_id = a.song_id AND abs(a.start_ms - b.start_ms) <= 350) THEN 1 ELSE 0 END) AS hit FROM a GROUP BY song_id),
y AS (SELECT song_id, count(*) AS ref, sum(CASE WHEN EXISTS (SELECT 1 FROM a WHERE b.song_id = a.song_id AND abs(a.start_ms - b.start_ms) <= 350) THEN 1 ELSE 0 END) AS hit FROM b GROUP BY song_id),
z AS (SELECT song_id, coalesce(x.hit / nullif(est, 0)::DOUBLE, 0) AS p, coalesce(y.hit / nullif(ref, 0)::DOUBLE, 0) AS r FROM x FULL JOIN y USING (song_id))
SELECT song_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM z""")
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of one track's onsets against another's, within 350 ms."""
    n = notes(spark, sf_dir)
    side = lambda t, c: n.where(F.col("track") == t).select("song_id", F.col("start_ms").alias(c)).distinct()
    a, b = side("click", "a_ms"), side("view", "b_ms")

    def rate(left: DataFrame, right: DataFrame, lt: str, rt: str, name: str) -> DataFrame:
        hit = near_join(left, right, ["song_id"], 350, lt, rt, "left_semi").groupBy("song_id").agg(F.count("*").alias("hit"))
        return left.groupBy("song_id").agg(F.count("*").alias("all")).join(hit, "song_id", "left").select("song_id", (F.coalesce("hit", F.lit(0)) / F.col("all")).alias(name))

    both = rate(a, b, "a_ms", "b_ms", "p").join(rate(b, a, "b_ms", "a_ms", "r"), "song_id", "full").na.fill(0.0, ["p", "r"])
    f1 = F.when(F.col("p") + F.col("r") == 0, F.lit(0.0)).otherwise(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return both.select("song_id", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query(f"""WITH {NOTES_SQL} SELECT track, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, round(avg(CASE WHEN value >= 20 THEN 1 ELSE 0 END), 6) AS kept_20, round(avg(CASE WHEN value >= 100 THEN 1 ELSE 0 END), 6) AS kept_100 FROM n GROUP BY track""")
def percentile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, and the share kept at two thresholds."""
    kept = lambda x: F.round(F.avg((F.col("value") >= x).cast("int")), 6).alias(f"kept_{x}")
    return notes(spark, sf_dir).groupBy("track").agg(*(F.percentile("value", q / 100).alias(f"p{q}") for q in (10, 50, 90)), kept(20), kept(100))


@query(f"WITH {NOTES_SQL} SELECT track, count(*) AS n, round(avg(value), 6) AS mean, median(value) AS mid, min(value) AS low, max(value) AS high FROM n GROUP BY track")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "value"
    return notes(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.median(v).alias("mid"), F.min(v).alias("low"), F.max(v).alias("high"))


@query(f"""WITH {NOTES_SQL}, e AS (SELECT song_id, start_ms // 60000 AS epoch, round(avg(amp), 6) AS acc, count(*) AS n FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY acc DESC, epoch) AS rn FROM e)
SELECT song_id, max(CASE WHEN rn = 1 THEN epoch END) AS best, round(avg(CASE WHEN rn <= 5 THEN acc END), 6) AS top5, round(sum(acc * n) / CAST(sum(n) AS DOUBLE), 4) AS weighted FROM r GROUP BY song_id""")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best epoch, the mean of the best five, and the mean weighted by size."""
    e = notes(spark, sf_dir).groupBy("song_id", F.expr("start_ms div 60000").alias("epoch")).agg(F.round(F.avg("amp"), 6).alias("acc"), F.count("*").alias("n"))
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("song_id").orderBy(F.col("acc").desc(), "epoch")))
    return e.groupBy("song_id").agg(F.max(F.when(F.col("rn") == 1, F.col("epoch"))).alias("best"), F.round(F.avg(F.when(F.col("rn") <= 5, F.col("acc"))), 6).alias("top5"), F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 4).alias("weighted"))


@query("""WITH s AS (SELECT o_custkey, min(o_orderkey) AS t0, max(o_orderkey) AS t1, count(*) AS n, round(sum(o_totalprice), 2) AS annotated FROM orders WHERE o_totalprice >= 1000 GROUP BY o_custkey)
SELECT o_custkey, greatest(t0 - 2, 0) AS t0, t1 + 2 AS t1, n, annotated FROM s ORDER BY annotated DESC, o_custkey LIMIT 2000""")
def merged_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces merged by id: their span with a margin and their sum, of the 2,000 with the largest sums."""
    s = table(spark, sf_dir, "orders").where("o_totalprice >= 1000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("t0"), F.max("o_orderkey").alias("t1"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("annotated"))
    return s.select("o_custkey", F.greatest(F.col("t0") - 2, F.lit(0)).alias("t0"), (F.col("t1") + 2).alias("t1"), "n", "annotated").orderBy(F.col("annotated").desc(), "o_custkey").limit(2000)


@query(f"""WITH {NOTES_SQL}, m AS (SELECT song_id, start_ms // 5000 AS f, midi % 12 AS pc, sum(amp) AS v FROM n GROUP BY ALL)
SELECT song_id, f, pc, round(CASE WHEN max(v) OVER w = 0 THEN 0 ELSE v / CAST(max(v) OVER w AS DOUBLE) END, 6) AS x, round(sqrt(CAST(sum(v * v) OVER w AS DOUBLE)), 6) AS norm FROM m WINDOW w AS (PARTITION BY song_id, f)""")
def frame_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch-class mass of each frame over its largest (0 where that is 0), and its length."""
    m = notes(spark, sf_dir).groupBy("song_id", F.expr("start_ms div 5000").alias("f"), pitch_class().alias("pc")).agg(F.sum("amp").alias("v"))
    w = Window.partitionBy("song_id", "f")
    return m.select("song_id", "f", "pc", F.round(F.coalesce(F.try_divide("v", F.max("v").over(w)), F.lit(0.0)), 6).alias("x"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v")).over(w).cast("double")), 6).alias("norm"))


@query(f"WITH {NOTES_SQL} SELECT song_id, start_ms // 5000 AS f, round(sqrt(avg(value * value)), 6) AS rms, round(avg(CASE WHEN amp >= 25 THEN 1 ELSE 0 END) * sqrt(median(value)), 6) AS sustain FROM n GROUP BY ALL HAVING count(*) >= 8")
def slice_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of each slice, and the share of loud rows times the root of the median; eight rows at least."""
    g = notes(spark, sf_dir).groupBy("song_id", F.expr("start_ms div 5000").alias("f"))
    loud = F.avg((F.col("amp") >= 25).cast("int"))
    return g.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.round(loud * F.sqrt(F.median("value")), 6).alias("sustain")).where("n >= 8").drop("n")


@query(f"""WITH {NOTES_SQL}, s AS (SELECT song_id, start_ms // 5000 AS f, track, CAST(sum(amp) AS DOUBLE) AS v, CASE track WHEN 'view' THEN 0.8 WHEN 'click' THEN 0.6 ELSE 0.25 END AS w, CASE track WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS prio FROM n GROUP BY ALL),
p AS (SELECT *, min(CASE WHEN v >= 40 THEN prio * 100000 + hash_no END) OVER (PARTITION BY song_id, f) AS lead FROM (SELECT *, CASE track WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 0 END AS hash_no FROM s))
SELECT song_id, f, round(sum(CASE WHEN prio * 100000 + hash_no = lead THEN 1.0 ELSE w END * v), 6) AS blend, max(CASE WHEN prio * 100000 + hash_no = lead THEN track END) AS source FROM p GROUP BY song_id, f""")
def evidence_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by priority: the first that passes its gate counts in full, the others by their weight."""
    s = notes(spark, sf_dir).groupBy("song_id", F.expr("start_ms div 5000").alias("f"), "track").agg(F.sum("amp").cast("double").alias("v"))
    w = F.when(F.col("track") == "view", 0.8).when(F.col("track") == "click", 0.6).otherwise(0.25)
    order = F.struct(F.when(F.col("track") == "view", 1).when(F.col("track") == "click", 2).otherwise(3), F.col("track"))
    s = s.withColumn("first", F.min_by("track", F.when(F.col("v") >= 40, order)).over(Window.partitionBy("song_id", "f")))
    lead = F.col("track").eqNullSafe(F.col("first"))
    return s.groupBy("song_id", "f").agg(F.round(F.sum(F.when(lead, 1.0).otherwise(w) * F.col("v")), 6).alias("blend"), F.first("first").alias("source"))


@query(f"""WITH {NOTES_SQL}, a AS (SELECT song_id, start_ms // 250 AS i, min(midi % 12) AS pc FROM n WHERE track = 'click' GROUP BY ALL), b AS (SELECT song_id, start_ms // 250 AS i, min(midi % 12) AS pc FROM n WHERE track = 'view' GROUP BY ALL)
SELECT song_id, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(avg(CASE WHEN a.pc = b.pc THEN 1 ELSE 0 END), 6) END AS root FROM a JOIN b USING (song_id, i) GROUP BY song_id""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement where both sides have a value; null below five samples."""
    n = notes(spark, sf_dir)
    side = lambda t, c: n.where(F.col("track") == t).groupBy("song_id", F.expr("start_ms div 250").alias("i")).agg(F.min(pitch_class()).alias(c))
    both = side("click", "a").join(side("view", "b"), ["song_id", "i"]).groupBy("song_id").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("x"))
    return both.select("song_id", "n", F.when(F.col("n") >= 5, F.round("x", 6)).alias("root"))
