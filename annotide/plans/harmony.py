"""Chord, key and spelling queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.dims import FLAT_NAMES, KS_MAJOR, KS_MINOR, MINORISH, ROMAN_MAJOR, ROMAN_MINOR, SUFFIX_LABEL, TEMPLATES, values_sql
from annotide.operators.harmony import best_chords, rival_gap
from annotide.operators.stateful import lattice_path
from annotide.operators.temporal import top_k
from annotide.plans.registry import query
from annotide.plans.windows import CHORDS_SQL, LABELS_SQL, MASKS_SQL, frame_labels, grid_masks
from annotide.sources.notes import NOTES_SQL, notes

RANKED_SQL = f"{MASKS_SQL}, {CHORDS_SQL.replace('PENALTY', '1.5')}"


def song_masks(n: DataFrame) -> DataFrame:
    return grid_masks(n).where("mask is not null")


@query(f"WITH {RANKED_SQL} SELECT mask, rank, CAST(root AS INTEGER) AS root, sfx, score FROM rk WHERE rank <= 8")
def chord_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight chords of every set of pitch classes that occurs."""
    masks = song_masks(notes(spark, sf_dir)).select("mask").distinct()
    return best_chords(masks, 8, how="inner").select("mask", "rank", "root", "sfx", "score")


@query(f"WITH {MASKS_SQL}, {CHORDS_SQL.replace('PENALTY', '1.0')} SELECT mask, rank, CAST(root AS INTEGER) AS root, sfx, score FROM rk WHERE rank <= 16")
def chord_candidates_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen of them, with a milder price for missing tones."""
    masks = song_masks(notes(spark, sf_dir)).select("mask").distinct()
    return best_chords(masks, 16, missing_penalty=1.0, how="inner").select("mask", "rank", "root", "sfx", "score")


NAMES = "[" + ", ".join(f"'{n}'" for n in FLAT_NAMES) + "]"


@query(f"""WITH {RANKED_SQL}, b AS (SELECT g.song_id, t, min(midi) % 12 AS bass_pc FROM g JOIN n ON g.song_id = n.song_id AND start_ms <= t AND t < end_ms GROUP BY ALL)
SELECT h.song_id, h.t, {NAMES}[root + 1] || sfx || CASE WHEN bass_pc <> root THEN '/' || {NAMES}[bass_pc + 1] ELSE '' END AS chord, score FROM hits h JOIN rk ON rk.mask = h.mask AND rank = 1 JOIN b ON b.song_id = h.song_id AND b.t = h.t""")
def chord_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chord at each grid point by name, with its bass after a slash where that is not the root."""
    from annotide.plans.joins import bass_at

    n = notes(spark, sf_dir)
    names = F.array(*map(F.lit, FLAT_NAMES))
    best = best_chords(song_masks(n), 1, how="inner").join(bass_at(spark, sf_dir), ["song_id", "t"])
    slash = F.when(F.col("bass_pc") != F.col("root"), F.concat(F.lit("/"), F.get(names, F.col("bass_pc").cast("int")))).otherwise("")
    return best.select("song_id", "t", F.concat(F.get(names, F.col("root")), F.col("sfx"), slash).alias("chord"), "score")


@query(f"""WITH {RANKED_SQL}, k AS (SELECT * FROM rk WHERE rank <= 8), top AS (SELECT mask, root AS top_root, sfx, score AS best FROM k WHERE rank = 1),
gp AS (SELECT top.mask, any_value(top_root) AS root, any_value(top.sfx) AS sfx, any_value(best) AS best, coalesce(any_value(best) - max(CASE WHEN k.root <> top_root THEN k.score END), 4.0) AS gap FROM top JOIN k ON k.mask = top.mask GROUP BY top.mask)
SELECT mask, CAST(root AS INTEGER) AS root, sfx, best, CAST(gap AS DOUBLE) AS gap, round(1 / (1 + exp(-gap / 2)), 9) AS conf FROM gp""")
def rival_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead of the best chord over the best of another root, as a confidence."""
    masks = song_masks(notes(spark, sf_dir)).select("mask").distinct()
    return rival_gap(best_chords(masks, 8, how="inner"), ["mask"]).withColumn("conf", F.round(1 / (1 + F.exp(-F.col("gap") / 2)), 9))


@query(f"""WITH {RANKED_SQL}, k AS (SELECT * FROM rk WHERE rank BETWEEN 1 AND 8), top AS (SELECT mask, root AS top_root FROM k WHERE rank = 1),
f AS (SELECT k.*, top_root, row_number() OVER (PARTITION BY k.mask, k.root ORDER BY rank) AS in_root FROM k JOIN top ON top.mask = k.mask WHERE rank > 1),
d AS (SELECT *, CASE WHEN in_root = 1 AND root <> top_root THEN 1 ELSE 0 END AS fresh FROM f),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY mask ORDER BY rank ROWS UNBOUNDED PRECEDING) AS nth FROM d),
p AS (SELECT *, CASE WHEN fresh = 1 AND nth <= 3 THEN 0 ELSE 1 END AS phase FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY phase, rank) AS place FROM p)
SELECT mask, CAST(place AS INTEGER) AS place, CAST(root AS INTEGER) AS root, sfx FROM o WHERE place <= 4""")
def alts_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four alternatives to the best chord: up to three of new roots first, then the rest in order."""
    masks = song_masks(notes(spark, sf_dir)).select("mask").distinct()
    c = best_chords(masks, 8, how="inner")
    per = Window.partitionBy("mask")
    c = c.withColumn("top_root", F.first("root").over(per.orderBy("rank"))).where("rank > 1")
    c = c.withColumn("in_root", F.row_number().over(Window.partitionBy("mask", "root").orderBy("rank")))
    fresh = ((F.col("in_root") == 1) & (F.col("root") != F.col("top_root"))).cast("int")
    c = c.withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(per.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    phase = F.when((F.col("fresh") == 1) & (F.col("nth") <= 3), 0).otherwise(1)
    return c.withColumn("place", F.row_number().over(per.orderBy(phase, "rank"))).where("place <= 4").select("mask", "place", "root", "sfx")


PROFILES = [(mode, t, pc, prof[(pc - t) % 12]) for mode, prof in (("maj", KS_MAJOR), ("min", KS_MINOR)) for t in range(12) for pc in range(12)]

KEYS_SQL = f"""{NOTES_SQL}, pf AS (SELECT * FROM (VALUES {values_sql(PROFILES)}) v(mode, tonic, pc, w)),
ms AS (SELECT song_id, midi % 12 AS pc, sum((end_ms - start_ms) * amp)::DOUBLE AS mass FROM n GROUP BY ALL), al AS (SELECT song_id, pc, coalesce(mass, 0) AS mass FROM (SELECT DISTINCT song_id FROM n) CROSS JOIN (SELECT DISTINCT pc FROM pf) LEFT JOIN ms USING (song_id, pc)),
co AS (SELECT song_id, mode, CAST(tonic AS INTEGER) AS tonic, round(corr(mass, w), 4) AS corr FROM al JOIN pf USING (pc) GROUP BY ALL),
kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY song_id ORDER BY corr DESC, mode, tonic) AS INTEGER) AS rank FROM co)"""


def keys(n: DataFrame, k: int) -> DataFrame:
    """The k keys of each song whose profile its pitch-class mass correlates with most."""
    spark = n.sparkSession
    profiles = F.broadcast(spark.createDataFrame(PROFILES, "mode string, tonic int, pc int, w double"))  # 288 rows
    mass = n.groupBy("song_id", F.pmod("midi", F.lit(12)).cast("int").alias("pc")).agg(F.sum((F.col("end_ms") - F.col("start_ms")) * F.col("amp")).cast("double").alias("m"))
    dense = mass.groupBy("song_id").agg(F.map_from_entries(F.collect_list(F.struct("pc", "m"))).alias("by_pc"))
    dense = dense.select("song_id", "by_pc", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc")).select("song_id", "pc", F.coalesce(F.try_element_at("by_pc", F.col("pc")), F.lit(0.0)).alias("mass"))
    corr = dense.join(profiles, "pc").groupBy("song_id", "mode", "tonic").agg(F.round(F.corr("mass", "w"), 4).alias("corr"))
    return top_k(corr, ["song_id"], [F.col("corr").desc(), F.col("mode"), F.col("tonic")], k)


@query(f"WITH {KEYS_SQL} SELECT * FROM kr WHERE rank <= 3")
def key_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(notes(spark, sf_dir), 3)


MINOR_SQL = "(" + ", ".join(f"'{m}'" for m in MINORISH) + ")"


@query(f"""WITH {KEYS_SQL}, {LABELS_SQL.replace(NOTES_SQL + ', ', '')}, k AS (SELECT song_id, CASE WHEN mode = 'min' THEN (tonic + 3) % 12 ELSE tonic END AS maj_pc, CASE WHEN mode = 'min' THEN tonic ELSE (tonic + 9) % 12 END AS min_pc FROM kr WHERE rank = 1),
c AS (SELECT song_id, t, CAST(split_part(label, ':', 1) AS INT) AS root, split_part(label, ':', 2) AS sfx, CASE WHEN t = max(t) OVER (PARTITION BY song_id) THEN 2 ELSE 1 END AS w FROM lab WHERE label <> 'N')
SELECT c.song_id, CAST(sum(CASE WHEN root = maj_pc AND sfx NOT IN {MINOR_SQL} THEN w ELSE 0 END) AS BIGINT) AS w_maj, CAST(sum(CASE WHEN root = min_pc AND sfx IN {MINOR_SQL} THEN w ELSE 0 END) AS BIGINT) AS w_min,
CASE WHEN sum(CASE WHEN root = min_pc AND sfx IN {MINOR_SQL} THEN w ELSE 0 END) > sum(CASE WHEN root = maj_pc AND sfx NOT IN {MINOR_SQL} THEN w ELSE 0 END) THEN 'min' ELSE 'maj' END AS mode FROM c JOIN k USING (song_id) GROUP BY c.song_id""")
def tonal_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Major or relative minor, by the frames on either tonic; the last chord counts double."""
    n = notes(spark, sf_dir)
    k = keys(n, 1).select("song_id", F.when(F.col("mode") == "min", F.pmod(F.col("tonic") + 3, F.lit(12))).otherwise(F.col("tonic")).alias("maj_pc"), F.when(F.col("mode") == "min", F.col("tonic")).otherwise(F.pmod(F.col("tonic") + 9, F.lit(12))).alias("min_pc"))
    c = frame_labels(n).where("label <> 'N'").withColumn("root", F.split_part("label", F.lit(":"), F.lit(1)).cast("int")).withColumn("sfx", F.split_part("label", F.lit(":"), F.lit(2)))
    c = c.withColumn("w", F.when(F.col("t") == F.max("t").over(Window.partitionBy("song_id")), 2).otherwise(1)).join(k, "song_id")
    minor = F.col("sfx").isin(MINORISH)
    votes = c.groupBy("song_id").agg(
        F.sum(F.when((F.col("root") == F.col("maj_pc")) & ~minor, F.col("w")).otherwise(0)).alias("w_maj"),
        F.sum(F.when((F.col("root") == F.col("min_pc")) & minor, F.col("w")).otherwise(0)).alias("w_min"),
    )
    return votes.withColumn("mode", F.when(F.col("w_min") > F.col("w_maj"), "min").otherwise("maj"))


ROMANS = "[" + ", ".join(f"'{r}'" for r in ROMAN_MAJOR) + "]"
ROMANS_MINOR = "[" + ", ".join(f"'{r}'" for r in ROMAN_MINOR) + "]"
CHORD_DIM = [(r, s) for r in range(12) for s, _ in TEMPLATES]


def roman(root: Column, sfx: Column, tonic: Column, minor: Column) -> Column:
    """Roman numeral of a chord: the degree's base, lower case for minor qualities, and the suffix's label."""
    deg = F.pmod(root - tonic, F.lit(12))
    base = F.when(minor, F.get(F.array(*map(F.lit, ROMAN_MINOR)), deg)).otherwise(F.get(F.array(*map(F.lit, ROMAN_MAJOR)), deg))
    labels = F.create_map(*(F.lit(v) for kv in SUFFIX_LABEL.items() for v in kv))
    return F.concat(F.when(sfx.isin(MINORISH), F.lower(base)).otherwise(F.upper(base)), F.coalesce(F.try_element_at(labels, sfx), sfx))


@query(f"""WITH d AS (SELECT * FROM (VALUES {values_sql(CHORD_DIM)}) v(root, sfx)), l AS (SELECT * FROM (VALUES {values_sql(SUFFIX_LABEL.items())}) v(sfx, lb)), x AS (SELECT n_nationkey, n_nationkey % 12 AS tonic, n_nationkey % 2 = 1 AS minor FROM nation),
b AS (SELECT n_nationkey, root, sfx, CASE WHEN minor THEN {ROMANS_MINOR}[(root - tonic + 12) % 12 + 1] ELSE {ROMANS}[(root - tonic + 12) % 12 + 1] END AS base FROM x, d)
SELECT n_nationkey, CAST(root AS INTEGER) AS root, b.sfx, CASE WHEN b.sfx IN {MINOR_SQL} THEN lower(base) ELSE upper(base) END || lb AS roman FROM b JOIN l ON l.sfx = b.sfx""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chord against the keys that the rows of nation stand for."""
    from annotide.sources.notes import table

    d = F.explode(F.array(*(F.struct(F.lit(r).alias("root"), F.lit(s).alias("sfx")) for r, s in CHORD_DIM)))
    x = table(spark, sf_dir, "nation").select("n_nationkey", d.alias("d")).select("n_nationkey", "d.*")
    return x.select("n_nationkey", "root", "sfx", roman(F.col("root"), F.col("sfx"), (F.col("n_nationkey") % 12).cast("int"), F.col("n_nationkey") % 2 == 1).alias("roman"))


@query(f"""WITH d AS (SELECT * FROM (VALUES {values_sql((r, s, iv) for r in range(12) for s, ivs in TEMPLATES for iv in ivs)}) v(root, sfx, iv)), x AS (SELECT n_nationkey, n_nationkey % 12 AS bass FROM nation),
p AS (SELECT n_nationkey, root, sfx, CASE WHEN 48 + root + iv > 74 AND 48 + root + iv - 12 > 48 + root THEN 48 + root + iv - 12 ELSE 48 + root + iv END AS p FROM x, d UNION SELECT n_nationkey, root, sfx, 36 + bass FROM x, d)
SELECT n_nationkey, CAST(root AS INTEGER) AS root, sfx, string_agg(p, ',' ORDER BY p) AS voicing FROM (SELECT DISTINCT * FROM p) GROUP BY ALL""")
def chord_voicings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of every chord, packed above C3, over the bass of each row of nation."""
    from annotide.sources.notes import table

    d = F.explode(F.array(*(F.struct(F.lit(r).alias("root"), F.lit(s).alias("sfx"), F.array(*map(F.lit, ivs)).alias("ivs")) for r in range(12) for s, ivs in TEMPLATES)))
    x = table(spark, sf_dir, "nation").select("n_nationkey", d.alias("d")).select("n_nationkey", "d.*")
    base = F.col("root") + 48
    pack = lambda iv: F.when((base + iv > 74) & (iv > 12), base + iv - 12).otherwise(base + iv)
    notes_ = F.array_sort(F.array_distinct(F.concat(F.array((F.lit(36) + F.col("n_nationkey") % 12).cast("int")), F.transform("ivs", pack))))
    return x.select("n_nationkey", "root", "sfx", F.array_join(notes_, ",").alias("voicing"))


@query(f"""WITH RECURSIVE {RANKED_SQL}, o AS (SELECT h.song_id, h.t, list({{'root': root, 'sfx': sfx, 'score': score}} ORDER BY rank) AS c, row_number() OVER (PARTITION BY h.song_id ORDER BY h.t) AS k FROM hits h JOIN rk ON rk.mask = h.mask AND rank <= 5 GROUP BY h.song_id, h.t),
d AS (SELECT (c[1].root - lag(c[1].root) OVER (PARTITION BY song_id ORDER BY t) + 12) % 12 AS dr FROM o),
mv AS (SELECT list(0.5::DOUBLE * greatest(least(round(ln((n + 1)::DOUBLE / (all_n + 12)) - ln(1 / 12.0::DOUBLE), 6), 2.0::DOUBLE), -2.0::DOUBLE) ORDER BY dr) AS m FROM (SELECT x.dr, count(d.dr) AS n, sum(count(d.dr)) OVER () AS all_n FROM (SELECT unnest(generate_series(0, 11)) AS dr) x LEFT JOIN d ON d.dr = x.dr GROUP BY x.dr)),
f AS (SELECT song_id, k, c, list_transform(c, lambda z: 0.0::DOUBLE + (z.score - c[1].score)) AS score, [1::BIGINT] AS back FROM o WHERE k = 1
  UNION ALL SELECT song_id, k, c, list_transform(list_zip(ways, c), lambda w: list_max(w[1]) + (w[2].score - c[1].score)), list_transform(ways, lambda w: CAST(list_position(w, list_max(w)) AS BIGINT))
  FROM (SELECT o.song_id, o.k, o.c, list_transform(o.c, lambda z: list_transform(list_zip(f.score, f.c), lambda p: p[1] + CASE WHEN p[2].root = z.root AND p[2].sfx = z.sfx THEN 0.0::DOUBLE ELSE mv.m[(z.root - p[2].root + 12) % 12 + 1] END)) AS ways FROM f JOIN o ON o.song_id = f.song_id AND o.k = f.k + 1, mv)),
b AS (SELECT song_id, k, CAST(list_position(score, list_max(score)) AS BIGINT) AS s FROM f WHERE k = (SELECT max(k) FROM o WHERE o.song_id = f.song_id)
  UNION ALL SELECT f2.song_id, b.k - 1, f2.back[b.s] FROM b JOIN f f2 ON f2.song_id = b.song_id AND f2.k = b.k WHERE b.k > 1)
SELECT b.song_id, o.t, CAST(b.s - 1 AS INTEGER) AS pick, CAST(o.c[b.s].root AS INTEGER) AS root, o.c[b.s].sfx AS sfx FROM b JOIN o ON o.song_id = b.song_id AND o.k = b.k""")
def lattice_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chords of the best path through each grid point's five candidates, where moves of the root that are common
    between the best ones are favoured; what a move is worth is a number for each of twelve."""
    best = best_chords(song_masks(notes(spark, sf_dir)), 5, how="inner")
    rows = best.groupBy("song_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "root", "sfx", "score"))), lambda c: F.struct(c["root"].alias("root"), c["sfx"].alias("sfx"), c["score"].alias("score"))).alias("c"))
    top = F.get("c", F.lit(0))["root"]
    moved = rows.select(F.pmod(top - F.lag(top).over(Window.partitionBy("song_id").orderBy("t")), F.lit(12)).alias("dr")).where("dr is not null").groupBy("dr").agg(F.count("*").alias("n"))
    n = {r["dr"]: r["n"] for r in moved.collect()}  # twelve at most
    moves = [0.5 * max(min(round(math.log((n.get(d, 0) + 1) / (sum(n.values()) + 12)) - math.log(1 / 12), 6), 2.0), -2.0) for d in range(12)]
    got = lattice_path(rows, "song_id", "t", "c", moves)
    chord = F.get("c", F.col("pick"))
    return got.join(rows, ["song_id", "t"]).select("song_id", "t", "pick", chord["root"].alias("root"), chord["sfx"].alias("sfx"))


def voicing(root: Column, sfx: Column, bass: Column) -> Column:
    """The pitches of a chord, packed above C3, over its bass an octave below."""
    ivs = F.create_map(*(x for s, v in TEMPLATES for x in (F.lit(s), F.array(*map(F.lit, v)))))
    base = root + 48
    pack = lambda iv: F.when((base + iv > 74) & (iv > 12), base + iv - 12).otherwise(base + iv)
    return F.array_sort(F.array_distinct(F.concat(F.array(bass + 36), F.transform(F.element_at(ivs, sfx), pack))))


@query(f"""WITH {KEYS_SQL}, {LABELS_SQL.replace(NOTES_SQL + ', ', '')}, ky AS (SELECT song_id, tonic, mode FROM kr WHERE rank = 1), lw AS (SELECT song_id, start_ms // 1000 * 1000 AS t, min(midi) % 12 AS bass FROM n GROUP BY ALL),
c AS (SELECT song_id, t, CAST(split_part(label, ':', 1) AS INT) AS root, split_part(label, ':', 2) AS sfx FROM lab WHERE label <> 'N'), sl AS (SELECT * FROM (VALUES {values_sql(SUFFIX_LABEL.items())}) v(sfx, lb)), iv AS (SELECT * FROM (VALUES {values_sql((s, v) for s, ivs in TEMPLATES for v in ivs)}) v(sfx, iv)),
x AS (SELECT c.song_id, c.t, root, c.sfx, coalesce(bass, root) AS bass, lb, CASE WHEN mode = 'min' THEN {ROMANS_MINOR}[(root - tonic + 12) % 12 + 1] ELSE {ROMANS}[(root - tonic + 12) % 12 + 1] END AS base FROM c JOIN ky USING (song_id) JOIN sl ON sl.sfx = c.sfx LEFT JOIN lw ON lw.song_id = c.song_id AND lw.t = c.t),
p AS (SELECT song_id, t, 48 + root + iv AS p FROM x JOIN iv USING (sfx) UNION SELECT song_id, t, 36 + bass FROM x), v AS (SELECT song_id, t, string_agg(p, ',' ORDER BY p) AS voicing FROM p GROUP BY ALL)
SELECT x.song_id, x.t, root, x.sfx, CASE WHEN x.sfx IN {MINOR_SQL} THEN lower(base) ELSE upper(base) END || lb AS roman, voicing FROM x JOIN v ON v.song_id = x.song_id AND v.t = x.t""")
def chords_in_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chord of every second of each song as a numeral of the song's key, and its pitches over the lowest note that
    begins there (over its root without one)."""
    n = notes(spark, sf_dir)
    k = keys(n, 1).select("song_id", "tonic", (F.col("mode") == "min").alias("minor"))
    low = n.groupBy("song_id", (F.expr("start_ms div 1000") * 1000).alias("t")).agg(F.pmod(F.min("midi"), F.lit(12)).alias("bass"))
    c = frame_labels(n).where("label <> 'N'").select("song_id", "t", F.split_part("label", F.lit(":"), F.lit(1)).cast("int").alias("root"), F.split_part("label", F.lit(":"), F.lit(2)).alias("sfx"))
    x = c.join(k, "song_id").join(low, ["song_id", "t"], "left")
    pitches = voicing(F.col("root"), F.col("sfx"), F.coalesce("bass", "root"))
    return x.select("song_id", "t", "root", "sfx", roman(F.col("root"), F.col("sfx"), F.col("tonic"), F.col("minor")).alias("roman"), F.array_join(pitches, ",").alias("voicing"))
