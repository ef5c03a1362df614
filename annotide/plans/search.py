"""Searches over shifts and tempi, fallback cascades, pairings and lookups by dependency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.operators.temporal import top_k
from annotide.plans.registry import query
from annotide.sources.notes import NOTES_SQL, notes, table


def chroma(n: DataFrame, track: str, value: str) -> DataFrame:
    """song_id, i, pc, value: pitch-class mass of a track in steps of 500 ms, each step of length 1."""
    v = n.where(F.col("track") == track).groupBy("song_id", F.expr("start_ms div 500").alias("i"), F.pmod("midi", F.lit(12)).alias("pc")).agg(F.sum(F.col("amp") + 1).cast("double").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("song_id", "i")))
    return v.select("song_id", "i", "pc", (F.col("v") / norm).alias(value))


@query(f"""WITH {NOTES_SQL}, v AS (SELECT song_id, track, start_ms // 500 AS i, midi % 12 AS pc, CAST(sum(amp + 1) AS DOUBLE) AS v FROM n WHERE track IN ('click', 'view') GROUP BY ALL), u AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY song_id, track, i)) AS x FROM v),
k AS (SELECT unnest(generate_series(-12, 12)) AS lag), c AS (SELECT a.song_id, lag, round(sum(a.x * b.x), 6) AS score FROM u a JOIN k ON true JOIN u b ON b.song_id = a.song_id AND b.pc = a.pc AND b.i = a.i - lag WHERE a.track = 'click' AND b.track = 'view' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, lag) AS rn, median(score) OVER (PARTITION BY song_id) AS mid FROM c)
SELECT song_id, lag, score, round(score - mid, 6) AS sharpness FROM r WHERE rn = 1""")
def chroma_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag at which two tracks' chroma agree most, and how far it stands out; only pairs that share a pitch class
    meet, so the sum over them is the sum of all cosines."""
    n = notes(spark, sf_dir)
    a = chroma(n, "click", "x").withColumn("lag", F.explode(F.sequence(F.lit(-12), F.lit(12)))).select("song_id", "pc", "lag", (F.col("i") - F.col("lag")).alias("i"), "x")
    c = a.join(chroma(n, "view", "y"), ["song_id", "pc", "i"]).groupBy("song_id", "lag").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("score"))
    mid = c.groupBy("song_id").agg(F.median("score").alias("mid"))
    best = top_k(c, ["song_id"], [F.col("score").desc(), F.col("lag")], 1)
    return best.join(mid, "song_id").select("song_id", "lag", "score", F.round(F.col("score") - F.col("mid"), 6).alias("sharpness"))


@query(f"""WITH {NOTES_SQL}, v AS (SELECT song_id, track, start_ms // 500 AS i, midi % 12 AS pc, CAST(sum(amp + 1) AS DOUBLE) AS v FROM n WHERE track IN ('click', 'view') GROUP BY ALL), u AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY song_id, track, i)) AS x FROM v),
k AS (SELECT unnest(generate_series(-12, 12)) AS lag), c AS (SELECT a.song_id, lag, round(sum(a.x * b.x), 6) AS score FROM u a JOIN k ON true JOIN u b ON b.song_id = a.song_id AND b.pc = a.pc AND b.i = a.i - lag WHERE a.track = 'click' AND b.track = 'view' GROUP BY ALL),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.song_id ORDER BY c.score DESC, c.lag) AS rn, p.score AS s0, q.score AS s2 FROM c LEFT JOIN c p ON p.song_id = c.song_id AND p.lag = c.lag - 1 LEFT JOIN c q ON q.song_id = c.song_id AND q.lag = c.lag + 1)
SELECT song_id, CAST(lag AS INTEGER) AS lag, round((lag + CASE WHEN abs(s0 - 2 * score + s2) > 1e-9 THEN 0.5e0 * (s0 - s2) / (s0 - 2 * score + s2) ELSE 0 END) * 0.5e0, 6) AS seconds FROM r WHERE rn = 1""")
def chroma_offset_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of chroma_offset moved to the top of the parabola through its score and those beside it, in seconds; at an
    edge, and where three scores lie on a line, the lag itself."""
    n = notes(spark, sf_dir)
    a = chroma(n, "click", "x").withColumn("lag", F.explode(F.sequence(F.lit(-12), F.lit(12)))).select("song_id", "pc", "lag", (F.col("i") - F.col("lag")).alias("i"), "x")
    c = a.join(chroma(n, "view", "y"), ["song_id", "pc", "i"]).groupBy("song_id", "lag").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("score"))
    w = Window.partitionBy("song_id").orderBy("lag")
    beside = lambda f: F.when(F.abs(f("lag").over(w) - F.col("lag")) == 1, f("score").over(w))
    best = top_k(c.withColumns({"s0": beside(F.lag), "s2": beside(F.lead)}), ["song_id"], [F.col("score").desc(), F.col("lag")], 1)
    bend = F.col("s0") - 2 * F.col("score") + F.col("s2")
    moved = F.when(F.abs(bend) > 1e-9, 0.5 * (F.col("s0") - F.col("s2")) / bend).otherwise(0.0)
    return best.select("song_id", "lag", F.round((F.col("lag") + moved) * 0.5, 6).alias("seconds"))


@query(f"""WITH {NOTES_SQL}, b AS (SELECT unnest(generate_series(70, 180, 5)) AS bpm), x AS (SELECT song_id, bpm, (start_ms % (60000 // bpm)) * 10 // (60000 // bpm) AS phase, count(*) AS c FROM n, b GROUP BY ALL),
s AS (SELECT song_id, bpm, max(c) AS hits, sum(c) AS total FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY hits DESC, bpm) AS rn FROM s)
SELECT song_id, CAST(rn AS INTEGER) AS rank, CAST(bpm AS INTEGER) AS bpm, round(hits / CAST(total AS DOUBLE), 6) AS lock FROM r WHERE rn <= 3""")
def tempo_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tempi under which most onsets fall into one tenth of the beat. Onsets are counted by place first, so
    that only counts meet every tempo."""
    n = notes(spark, sf_dir).groupBy("song_id", "start_ms").agg(F.count("*").alias("k"))
    x = n.withColumn("bpm", F.explode(F.sequence(F.lit(70), F.lit(180), F.lit(5)))).withColumn("period", F.expr("60000 div bpm"))
    x = x.groupBy("song_id", "bpm", F.expr("(start_ms % period) * 10 div period").alias("phase")).agg(F.sum("k").alias("c"))
    s = x.groupBy("song_id", "bpm").agg(F.max("c").alias("hits"), F.sum("c").alias("total"))
    return top_k(s, ["song_id"], [F.col("hits").desc(), F.col("bpm")], 3).select("song_id", "rank", "bpm", F.round(F.col("hits") / F.col("total"), 6).alias("lock"))


@query(f"""WITH {NOTES_SQL}, v AS (SELECT song_id, start_ms // 1000 AS i, count(*) AS c FROM n GROUP BY ALL), k AS (SELECT unnest(generate_series(1, 16)) AS lag)
SELECT a.song_id, CAST(lag AS INTEGER) AS lag, CAST(sum(a.c * b.c) AS BIGINT) AS product FROM v a JOIN k ON true JOIN v b ON b.song_id = a.song_id AND b.i = a.i + lag GROUP BY ALL""")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of onset counts with those a lag later."""
    v = notes(spark, sf_dir).groupBy("song_id", F.expr("start_ms div 1000").alias("i")).agg(F.count("*").alias("c"))
    a = v.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(16)))).select("song_id", "lag", (F.col("i") + F.col("lag")).alias("i"), F.col("c").alias("d"))
    return a.join(v, ["song_id", "i"]).groupBy("song_id", "lag").agg(F.sum(F.col("c") * F.col("d")).alias("product"))


@query(f"""WITH {NOTES_SQL}, f AS (SELECT song_id, start_ms // 5000 AS f, median(CASE WHEN midi < 48 THEN midi END) AS low, avg(CASE WHEN midi < 48 THEN 1 ELSE 0 END) AS share, min(CASE WHEN track = 'view' THEN midi % 12 END) AS chroma FROM n GROUP BY ALL)
SELECT song_id, f, CAST(coalesce(CASE WHEN share >= 0.2 THEN CAST(round_even(low, 0) AS BIGINT) % 12 END, chroma, -1) AS INTEGER) AS pc, CASE WHEN share >= 0.2 THEN round(share, 6) WHEN chroma IS NOT NULL THEN 0.2 ELSE 0 END AS conf FROM f""")
def bass_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bass of each slice: the median low note if there are enough, else a fallback, else -1."""
    low = F.when(F.col("midi") < 48, F.col("midi"))
    g = notes(spark, sf_dir).groupBy("song_id", F.expr("start_ms div 5000").alias("f"))
    f = g.agg(F.median(low).alias("low"), F.avg((F.col("midi") < 48).cast("int")).alias("share"), F.min(F.when(F.col("track") == "view", F.pmod("midi", F.lit(12)))).alias("chroma"))
    own = F.when(F.col("share") >= 0.2, F.pmod(F.rint("low").cast("int"), F.lit(12)))
    conf = F.when(F.col("share") >= 0.2, F.round("share", 6)).when(F.col("chroma").isNotNull(), 0.2).otherwise(0.0)
    return f.select("song_id", "f", F.coalesce(own, "chroma", F.lit(-1)).alias("pc"), conf.alias("conf"))


@query("""WITH s AS (SELECT c_custkey, max(CASE WHEN o_totalprice > 100000 THEN o_totalprice END) AS score FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, score, row_number() OVER (ORDER BY score DESC NULLS LAST, c_custkey) AS place FROM s ORDER BY score DESC NULLS LAST, c_custkey LIMIT 100""")
def ranking_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best by score, unscored ones last; numbered after the cut."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("score"))
    s = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    best = s.orderBy(F.desc_nulls_last("score"), "c_custkey").limit(100)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "c_custkey")).cast("long"))


@query("""WITH p AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS stem, p_brand < 'Brand#2' AS left_side FROM part)
SELECT a.p_partkey, count(*) AS pairs, min(b.p_partkey) AS first FROM p a JOIN p b ON a.left_side AND NOT b.left_side AND a.stem = b.stem AND starts_with(b.p_name, a.stem) GROUP BY a.p_partkey""")
def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of some brands paired with those of the others by their stem: an equality on the stem, then the prefix
    test; counted on one side before they meet."""
    p = table(spark, sf_dir, "part").withColumn("stem", F.split_part("p_name", F.lit(" "), F.lit(1)))
    b = p.where("not p_brand < 'Brand#2' and startswith(p_name, stem)").groupBy("stem").agg(F.count("*").alias("pairs"), F.min("p_partkey").alias("first"))
    return p.where("p_brand < 'Brand#2'").join(b, "stem").select("p_partkey", "pairs", "first")


#: Stage and the stages that directly depend on it.
DEPENDANTS = [("decode", "stems"), ("decode", "posterior"), ("stems", "beats"), ("stems", "chroma"), ("stems", "bass"), ("beats", "chroma"), ("beats", "bass"), ("chroma", "key"), ("chroma", "chords"), ("bass", "chords"), ("key", "chords"), ("posterior", "chords")]


@query("""WITH d AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in DEPENDANTS) + """) v(stage, needs)), s AS (SELECT DISTINCT stage FROM d UNION SELECT DISTINCT needs FROM d),
c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'stems' WHEN 1 THEN 'beats' WHEN 2 THEN 'chroma' ELSE 'posterior' END AS changed FROM customer)
SELECT c_custkey, s.stage FROM c, s WHERE s.stage <> changed AND s.stage NOT IN (SELECT needs FROM d WHERE d.stage = changed)""")
def still_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of each song that stay valid when one stage changes: all but itself and its direct dependants."""
    changed = F.when(F.col("c_custkey") % 4 == 0, "stems").when(F.col("c_custkey") % 4 == 1, "beats").when(F.col("c_custkey") % 4 == 2, "chroma").otherwise("posterior")
    stages = sorted({x for pair in DEPENDANTS for x in pair})
    valid = {s: [x for x in stages if x != s and (s, x) not in DEPENDANTS] for s in stages}
    lookup = F.create_map(*(c for k, v in valid.items() for c in (F.lit(k), F.array(*map(F.lit, v)))))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.try_element_at(lookup, changed)).alias("stage"))


@query(f"""WITH {NOTES_SQL}, l AS (SELECT song_id, max(end_ms) AS last FROM n GROUP BY song_id) SELECT song_id, count(*) AS notes, CAST(sum(t) AS BIGINT) AS onsets FROM (SELECT song_id, start_ms AS t FROM n UNION ALL SELECT n.song_id, start_ms + last FROM n JOIN l USING (song_id) WHERE track = 'click') GROUP BY song_id""")
def appended_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one track copied to the end of the song."""
    n = notes(spark, sf_dir).withColumn("last", F.max("end_ms").over(Window.partitionBy("song_id")))
    both = n.select("song_id", F.explode(F.when(F.col("track") == "click", F.array("start_ms", F.col("start_ms") + F.col("last"))).otherwise(F.array("start_ms"))).alias("t"))
    return both.groupBy("song_id").agg(F.count("*").alias("notes"), F.sum("t").alias("onsets"))


@query("""WITH e AS (SELECT vec_id, CAST(vec_id % 70 AS BIGINT) AS keep, list_transform(embedding, lambda x: CAST(round_even(greatest(least(x::DOUBLE, 1), -1) * 32767, 0) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id, array_to_string(list_resize(v[1:keep], 64, 0), ',') AS samples FROM e""")
def padded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 16-bit samples, cut to a length of their own and padded to 64."""
    v = F.transform("embedding", lambda x: F.rint(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 32767).cast("long"))
    cut = F.slice(v, F.lit(1), F.least(F.col("vec_id") % 70, F.lit(64)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.concat(cut, F.array_repeat(F.lit(0).cast("long"), 64 - F.size(cut))), ",").alias("samples"))
