"""Scalar functions on the rows of test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.dims import FLAT_NAMES, LETTER_PC, SHARP_NAMES, TOKEN_SUFFIX, values_sql
from annotide.plans.registry import query
from annotide.sources.notes import NOTES_SQL, notes, table

LETTERS = "CDEFGAB"
MAJOR_STEPS, MINOR_STEPS = [0, 2, 4, 5, 7, 9, 11], [0, 2, 3, 5, 7, 8, 10]
SUFFIXES = sorted(TOKEN_SUFFIX)


def lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in pairs.items() for v in kv)), key)


#: One chord token for each part: a letter, an accidental (s is sharp unless sus follows), a suffix, sometimes a bass.
TOKENS_SQL = f"""sx AS (SELECT * FROM (VALUES {values_sql(enumerate(SUFFIXES))}) v(i, s)),
tk AS (SELECT p_partkey, substr('{LETTERS}', CAST(p_partkey % 7 + 1 AS INT), 1) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 's' ELSE 'b' END || s || CASE WHEN p_partkey % 5 = 0 THEN '/G' ELSE '' END AS token FROM part JOIN sx ON i = p_partkey % {len(SUFFIXES)})"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    letter = F.substring(F.lit(LETTERS), (k % 7 + 1).cast("int"), F.lit(1))
    accidental = F.when(k % 3 == 0, "").when(k % 3 == 1, "s").otherwise("b")
    sfx = F.get(F.array(*map(F.lit, SUFFIXES)), (k % len(SUFFIXES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(letter, accidental, sfx, F.when(k % 5 == 0, "/G").otherwise("")).alias("token"))


def parse_token(token: Column) -> tuple[Column, Column]:
    """Root pitch class and core quality of a chord token; null where it is none or its suffix is unknown."""
    m = lambda g: F.regexp_extract(F.split_part(token, F.lit("/"), F.lit(1)), r"^([A-G])(s(?!us)|b)?(.*)$", g)
    shift = F.when(m(2) == "s", 1).when(m(2) == "b", -1).otherwise(0)
    return F.pmod(lookup(LETTER_PC, m(1)) + shift, F.lit(12)), lookup(TOKEN_SUFFIX, m(3))


@query(f"""WITH {TOKENS_SQL}, lp AS (SELECT * FROM (VALUES {values_sql(LETTER_PC.items())}) v(letter, pc)), ql AS (SELECT * FROM (VALUES {values_sql(TOKEN_SUFFIX.items())}) v(sfx, q)),
a AS (SELECT p_partkey, token, split_part(token, '/', 1) AS t FROM tk), b AS (SELECT *, substr(t, 1, 1) AS letter, CASE WHEN substr(t, 2, 1) = 's' AND substr(t, 2, 3) <> 'sus' THEN 1 WHEN substr(t, 2, 1) = 'b' THEN -1 ELSE 0 END AS acc FROM a)
SELECT p_partkey, token, (pc + acc + 12) % 12 AS root, q AS quality FROM b JOIN lp USING (letter) LEFT JOIN ql ON ql.sfx = substr(t, CASE WHEN acc = 0 THEN 2 ELSE 3 END)""")
def parse_chord_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, quality = parse_token(F.col("token"))
    return tokens(spark, sf_dir).select("p_partkey", "token", root.alias("root"), quality.alias("quality"))


def spelling(tonic: int, letter: int, minor: bool) -> list[str]:
    """Names of the twelve pitch classes from the tonic: scale degrees by letter, the others by the key's side."""
    natural = [LETTER_PC[x] for x in LETTERS]
    flat_side = tonic in ((2, 7, 0, 5, 10, 3) if minor else (5, 10, 3, 8, 1, 6))
    names = list(FLAT_NAMES if flat_side else SHARP_NAMES)
    for degree, step in enumerate(MINOR_STEPS if minor else MAJOR_STEPS):
        pc, at = (tonic + step) % 12, (letter + degree) % 7
        off = (pc - natural[at] + 6) % 12 - 6
        names[pc] = LETTERS[at] + ("#" * off if off > 0 else "b" * -off)
    return names


SPELLINGS = {f"{x}{'m' if minor else ''}": spelling(LETTER_PC[x], i, minor) for i, x in enumerate(LETTERS) for minor in (False, True)}


@query(f"""WITH s AS (SELECT * FROM (VALUES {values_sql((k, i, v) for k, names in SPELLINGS.items() for i, v in enumerate(names))}) v(key, pc, name)), x AS (SELECT c_custkey, substr('{LETTERS}', CAST(c_custkey % 7 + 1 AS INT), 1) || CASE WHEN c_nationkey % 2 = 1 THEN 'm' ELSE '' END AS key, CAST(c_custkey % 12 AS INT) AS pc FROM customer)
SELECT c_custkey, x.key, name FROM x JOIN s ON s.key = x.key AND s.pc = x.pc""")
def key_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name of a pitch class in a key."""
    k = F.col("c_custkey")
    key = F.concat(F.substring(F.lit(LETTERS), (k % 7 + 1).cast("int"), F.lit(1)), F.when(F.col("c_nationkey") % 2 == 1, "m").otherwise(""))
    flat = {f"{a}:{i}": v for a, names in SPELLINGS.items() for i, v in enumerate(names)}
    x = table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), (k % 12).cast("int").cast("string").alias("pc"))
    return x.select("c_custkey", "key", lookup(flat, F.concat_ws(":", "key", "pc")).alias("name"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice / 97) AS bpm FROM lineitem WHERE l_extendedprice >= 97)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN bpm < 70 THEN bpm * pow(2, ceil(log2(70 / bpm))) WHEN bpm > 180 THEN bpm / pow(2, ceil(log2(bpm / 180))) ELSE bpm END, 6) AS folded FROM x""")
def bpm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempi brought to 70 to 180 by doubling or halving."""
    x = table(spark, sf_dir, "lineitem").where("l_extendedprice >= 97").withColumn("bpm", F.col("l_extendedprice") / 97)
    b = F.col("bpm")
    folded = F.when(b < 70, b * F.pow(F.lit(2.0), F.ceil(F.log2(70 / b)))).when(b > 180, b / F.pow(F.lit(2.0), F.ceil(F.log2(b / 180)))).otherwise(b)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(folded, 6).alias("folded"))


@query(f"""WITH {NOTES_SQL}, b AS (SELECT note_id, start_ms / 500.0::DOUBLE AS s, greatest((end_ms - start_ms) / 500.0::DOUBLE, 0) AS d FROM n),
q AS (SELECT *, round_even(s * 4, 0) / 4 AS a4, round_even(s * 3, 0) / 3 AS a3 FROM b)
SELECT note_id, round(CASE WHEN abs(a3 - s) < abs(a4 - s) THEN a3 ELSE a4 END, 6) AS at, round(CASE WHEN abs(a3 - s) < abs(a4 - s) THEN greatest(round_even(d * 3, 0), 1) / 3 ELSE greatest(round_even(d * 4, 0), 1) / 4 END, 6) AS length FROM q""")
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets and lengths in beats on the nearer of a quarter and a third grid; one step at least."""
    b = notes(spark, sf_dir).select("note_id", (F.col("start_ms") / 500).alias("s"), F.greatest((F.col("end_ms") - F.col("start_ms")) / 500, F.lit(0.0)).alias("d"))
    on = lambda c, k: F.rint(F.col(c) * k) / k
    third = F.abs(on("s", 3) - F.col("s")) < F.abs(on("s", 4) - F.col("s"))
    least = lambda k: F.greatest(F.rint(F.col("d") * k), F.lit(1.0)) / k
    return b.select("note_id", F.round(F.when(third, on("s", 3)).otherwise(on("s", 4)), 6).alias("at"), F.round(F.when(third, least(3)).otherwise(least(4)), 6).alias("length"))


TEMPO_SQL = f"""{NOTES_SQL}, tm AS (SELECT DISTINCT song_id, start_ms AS tick, 300 + (min(note_id) OVER (PARTITION BY song_id, start_ms)) % 400 AS us FROM n WHERE track = 'error'),
tc AS (SELECT *, coalesce(sum((nxt - tick) * us) OVER (PARTITION BY song_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT *, lead(tick) OVER (PARTITION BY song_id ORDER BY tick) AS nxt FROM tm))"""


def tempo_map(n: DataFrame) -> DataFrame:
    """song_id, t, us (length of a tick), base (time of the change): each song's tempo changes with the time before them."""
    w = Window.partitionBy("song_id").orderBy("t")
    m = n.where("track = 'error'").groupBy("song_id", F.col("start_ms").alias("t")).agg((300 + F.min("note_id") % 400).alias("us"))
    m = m.withColumn("span", (F.lead("t").over(w) - F.col("t")) * F.col("us"))
    return m.select("song_id", "t", "us", F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


@query(f"""WITH {TEMPO_SQL}, c AS (SELECT song_id, tick, us, CAST(base AS BIGINT) AS base FROM tc)
SELECT note_id, CASE WHEN tick IS NULL THEN n.start_ms * 500 ELSE base + (n.start_ms - tick) * us END AS time_us FROM n ASOF LEFT JOIN c ON n.song_id = c.song_id AND n.start_ms >= c.tick""")
def tick_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to microseconds over the tempo map; 500 us a tick before its first change."""
    from annotide.operators.temporal import asof_join

    n = notes(spark, sf_dir)
    m = tempo_map(n).withColumn("tick", F.col("t"))
    at = asof_join(n.select("note_id", "song_id", F.col("start_ms").alias("t")), m, ["song_id"], "t", ["tick", "us", "base"], bucket=60_000)
    return at.select("note_id", F.when(F.col("tick").isNull(), F.col("t") * 500).otherwise(F.col("base") + (F.col("t") - F.col("tick")) * F.col("us")).alias("time_us"))


@query(f"""WITH {NOTES_SQL}, k AS (SELECT unnest(generate_series(-5, 6)) AS k), y AS (SELECT note_id, (midi % 12) * 14 + note_id % 14 AS label FROM n WHERE note_id % 3 > 0 UNION ALL SELECT note_id, 168 FROM n WHERE note_id % 3 = 0)
SELECT note_id, CAST(k AS INTEGER) AS k, CASE WHEN label < 168 THEN (label // 14 + k + 12) % 12 * 14 + label % 14 ELSE label END AS label FROM y, k""")
def transpose_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class ids (root * 14 + quality) under every shift; silence stays."""
    y = notes(spark, sf_dir).select("note_id", F.when(F.col("note_id") % 3 > 0, F.pmod("midi", F.lit(12)) * 14 + F.col("note_id") % 14).otherwise(F.lit(168)).cast("long").alias("y"), F.explode(F.sequence(F.lit(-5), F.lit(6))).alias("k"))
    moved = F.pmod(F.expr("y div 14") + F.col("k"), F.lit(12)) * 14 + F.col("y") % 14
    return y.select("note_id", "k", F.when(F.col("y") < 168, moved).otherwise(F.col("y")).alias("label"))


@query(f"""WITH {NOTES_SQL} SELECT note_id, CAST(greatest(least(trunc(40 + 70 * (amp / 100.0::DOUBLE)), 127), 1) AS BIGINT) AS soft, CAST(round_even(127 * (amp / 100.0::DOUBLE), 0) AS BIGINT) AS full,
 lpad(CAST(start_ms // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock, round(440 * pow(2, (midi - 69) / 12.0::DOUBLE), 6) AS hz, CAST(round(69 + 12 * log2(value + 1)) AS BIGINT) AS back FROM n""")
def note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities, clock text and frequencies of notes."""
    a = F.col("amp") / 100
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return notes(spark, sf_dir).select(
        "note_id",
        F.greatest(F.least((40 + 70 * a).cast("long"), F.lit(127)), F.lit(1)).cast("long").alias("soft"),
        F.rint(127 * a).cast("long").alias("full"),
        F.concat(two(F.expr("start_ms div 60000")), F.lit(":"), two(F.expr("start_ms div 1000 % 60"))).alias("clock"),
        F.round(440 * F.pow(F.lit(2.0), (F.col("midi") - 69) / 12), 6).alias("hz"),
        F.round(69 + 12 * F.log2(F.col("value") + 1)).cast("long").alias("back"),
    )


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || substr(sha1(p_name || CAST(p_partkey AS VARCHAR)), 1, 8) AS slug, substr(sha1('{"brand": "' || p_brand || '", "size": ' || p_size || '}'), 1, 12) AS params_hash FROM part""")
def stage_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs with a short digest, and the digest of sorted JSON parameters."""
    slug = F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-"), F.substring(F.sha1(F.concat("p_name", F.col("p_partkey").cast("string"))), 1, 8))
    params = F.concat(F.lit('{"brand": "'), F.col("p_brand"), F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", slug.alias("slug"), F.substring(F.sha1(params), 1, 12).alias("params_hash"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(list_max(list_transform(v, lambda x: x / 0.5 - list_max(v) / 0.5)), 6) AS top, round(list_sum(list_transform(v, lambda x: exp(x / 0.5 - list_max(v) / 0.5))), 4) AS mass, round(list_sum(list_transform(v, lambda x: (x - 0.01) / 0.125)) / len(v), 5) AS z FROM e""")
def vector_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors over a temperature less their largest, and z-scores with a given mean and deviation."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("m", F.array_max("v"))
    add = lambda a, x: a + x
    shifted = F.transform("v", lambda x: x / 0.5 - F.col("m") / 0.5)
    return e.select("vec_id", F.round(F.array_max(shifted), 6).alias("top"), F.round(F.aggregate(F.transform(shifted, F.exp), F.lit(0.0), add), 4).alias("mass"), F.round(F.aggregate(F.transform("v", lambda x: (x - 0.01) / 0.125), F.lit(0.0), add) / F.size("v"), 5).alias("z"))


@query("""WITH c AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1),
p AS (SELECT vec_id, c.label, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c), 5) AS cosine FROM embeddings, c)
SELECT vec_id, label, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rn FROM p) WHERE rn = 1""")
def cosine_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class whose first vector each vector is closest to. Classes come in arrays of 1,024, so that a vector meets
    them without a row for each; with more classes it meets one array after the other."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    heads = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    numbered = heads.withColumn("block", F.expr("(row_number() over (order by label) - 1) div 1024"))
    blocks = numbered.groupBy("block").agg(F.collect_list(F.struct("label", "c")).alias("heads"))
    n_blocks = F.lit(-(-heads.count() // 1024))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = lambda v, c: F.round(dot(v, c) / F.sqrt(dot(v, v) * dot(c, c)), 5)
    met = e.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block")).join(blocks, "block")
    best = met.select("vec_id", F.array_max(F.transform("heads", lambda h: F.struct(cosine(F.col("v"), h["c"]).alias("cosine"), (-h["label"]).alias("minus"), h["label"].alias("label")))).alias("b"))
    return best.groupBy("vec_id").agg(F.max("b").alias("b")).select("vec_id", "b.label", "b.cosine")


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS peak, o_custkey % 100 / 100.0::DOUBLE AS bass, o_orderkey % 7 = 0 AS fixed FROM orders)
SELECT o_orderkey, CASE WHEN fixed THEN 'override' WHEN bass >= 0.8 THEN 'bass' WHEN peak > 200000 THEN 'chroma' ELSE 'none' END AS method,
 array_to_string(list_filter([CASE WHEN bass < 0.3 THEN 'weak_bass' END, CASE WHEN peak < 50000 THEN 'flat_peak' END, CASE WHEN fixed THEN 'fixed' END], lambda f: f IS NOT NULL), ',') AS flags,
 CASE WHEN peak / 150000 < 0.8 THEN 'short' WHEN peak / 150000 > 1.35 THEN 'long' ELSE 'ok' END AS verdict FROM x""")
def method_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade of thresholds, the list of warnings, and a verdict by ratio."""
    bass, peak, fixed = F.col("o_custkey") % 100 / 100, F.col("o_totalprice"), F.col("o_orderkey") % 7 == 0
    flags = F.filter(F.array(F.when(bass < 0.3, "weak_bass"), F.when(peak < 50000, "flat_peak"), F.when(fixed, "fixed")), lambda f: f.isNotNull())
    method = F.when(fixed, "override").when(bass >= 0.8, "bass").when(peak > 200000, "chroma").otherwise("none")
    verdict = F.when(peak / 150000 < 0.8, "short").when(peak / 150000 > 1.35, "long").otherwise("ok")
    return table(spark, sf_dir, "orders").select("o_orderkey", method.alias("method"), F.array_join(flags, ",").alias("flags"), verdict.alias("verdict"))


@query("""SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, list_distinct(list(l_returnflag || l_linestatus)) AS tags FROM lineitem GROUP BY 1) WHERE list_has_all(tags, ['NO', 'RF']) AND NOT list_contains(tags, 'AF')""")
def tag_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have all of some tags and none of others."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("tags"))
    return t.where((F.size(F.array_except(F.array(F.lit("NO"), F.lit("RF")), F.col("tags"))) == 0) & ~F.array_contains("tags", "AF")).select("o_orderkey")


@query(f"""WITH {NOTES_SQL}, b AS (SELECT DISTINCT song_id, start_ms AS b FROM n WHERE track = 'view'), i AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY b) - 1 AS i, lead(b) OVER (PARTITION BY song_id ORDER BY b) AS nb FROM b)
SELECT note_id, round(i.i + CASE WHEN nb IS NULL THEN 0 ELSE (n.start_ms - i.b)::DOUBLE / (nb - i.b) END, 6) AS beat FROM n ASOF LEFT JOIN i ON n.song_id = i.song_id AND n.start_ms >= i.b""")
def beats_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to beats, straight between neighbours; null before the first and held after the last."""
    from annotide.operators.temporal import asof_join

    n = notes(spark, sf_dir)
    w = Window.partitionBy("song_id").orderBy("t")
    b = n.where("track = 'view'").select("song_id", F.col("start_ms").alias("t")).distinct()
    b = b.select("song_id", "t", (F.row_number().over(w) - 1).alias("i"), F.col("t").alias("b"), F.lead("t").over(w).alias("nb"))
    at = asof_join(n.select("note_id", "song_id", F.col("start_ms").alias("t")), b, ["song_id"], "t", ["i", "b", "nb"], bucket=60_000)
    return at.select("note_id", F.round(F.col("i") + F.coalesce((F.col("t") - F.col("b")) / (F.col("nb") - F.col("b")), F.lit(0.0)), 6).alias("beat"))
