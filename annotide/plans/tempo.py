"""Queries of tempo, constant grids and alignment of onset strengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators import tempo
from annotide.plans.registry import query
from annotide.sources.notes import NOTES_SQL, notes

FPS = 20


def strengths(spark: SparkSession, sf_dir: str, track: str | None = None, name: str = "env") -> DataFrame:
    """song_id and the onset strength of each frame: what the notes that begin in it, of a track or of all, weigh."""
    n = notes(spark, sf_dir)
    n = n.where(F.col("track") == track) if track else n
    return tempo.series(n.select("song_id", F.expr(f"start_ms div {1000 // FPS}").alias("i"), (F.col("amp") + 1).alias("v")), "song_id", "i", "v", name)


def env_sql(name: str, where: str = "true") -> str:
    return f"""{name}e AS (SELECT song_id, start_ms // {1000 // FPS} AS i, CAST(sum(amp + 1) AS DOUBLE) AS v FROM n WHERE {where} GROUP BY ALL),
{name}d AS (SELECT r.song_id, r.i, coalesce(v, 0) AS v FROM (SELECT song_id, unnest(generate_series(0, max(i))) AS i FROM {name}e GROUP BY song_id) r LEFT JOIN {name}e e ON e.song_id = r.song_id AND e.i = r.i),
{name} AS (SELECT song_id, list(v ORDER BY i) AS env, count(*) AS n, avg(v) AS mean, max(v) AS top FROM {name}d GROUP BY song_id)"""


FOLDED = "CASE WHEN {0} < 70 THEN {0} * pow(2, ceil(log2(70 / {0}))) WHEN {0} > 180 THEN {0} / pow(2, ceil(log2({0} / 180))) ELSE {0} END"


def lerp_sql(x: str, place: str, last: str) -> str:
    return f"({x}[CAST(least(floor({place}), {last}) AS BIGINT) + 1] * (1 - ({place} - least(floor({place}), {last}))) + {x}[CAST(least(floor({place}), {last}) AS BIGINT) + 2] * ({place} - least(floor({place}), {last})))"


def comb_sql(bpm: str) -> str:
    teeth = (f"(60e0 / ({bpm}) * {FPS} * {m})" for m in (1, 2, 4))
    return "round(" + " + ".join(f"CASE WHEN {t} < n - 1 THEN {lerp_sql('ac', t, 'len(ac) - 2')} ELSE 0 END" for t in teeth) + ", 9)"


PICK_SQL = f"""{NOTES_SQL}, {env_sql("s")},
w AS (SELECT song_id, b, env[b + 1 : b + size] AS w, size FROM (SELECT song_id, env, least(160, n) AS size, unnest(generate_series(0, n - least(160, n), 40)) AS b FROM s)),
wa AS (SELECT song_id, b, k, p, CASE WHEN p > 0 THEN list_inner_product(w[: size - k], w[k + 1 :]) / p ELSE 0 END AS ac FROM (SELECT *, list_inner_product(w, w) AS p, unnest(generate_series(4, least(40, size - 1))) AS k FROM w)),
we AS (SELECT song_id, k FROM (SELECT *, row_number() OVER (PARTITION BY song_id, b ORDER BY round(ln(1 + 1e6 * ac) - 0.5e0 * pow(log2(1200e0 / k / 120), 2), 9) DESC, k) AS rn FROM wa WHERE p > 0) WHERE rn = 1),
ww AS (SELECT song_id, k FROM (SELECT song_id, k, row_number() OVER (PARTITION BY song_id ORDER BY round(ln(1 + 1e6 * ac) - 0.5e0 * pow(log2(1200e0 / k / 120), 2), 9) DESC, k) AS rn FROM (SELECT song_id, k, avg(ac) AS ac FROM wa GROUP BY song_id, k)) WHERE rn = 1),
wo AS (SELECT song_id, v FROM (SELECT song_id, v, row_number() OVER (PARTITION BY song_id ORDER BY c DESC, v) AS rn FROM (SELECT song_id, round(1200e0 / k, 1) AS v, count(*) AS c FROM we GROUP BY ALL)) WHERE rn <= 3),
pk AS (SELECT song_id, list([i] ORDER BY i) AS ps FROM (SELECT d.song_id, d.i, d.v, max(d.v) OVER (PARTITION BY d.song_id ORDER BY d.i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS largest, avg(d.v) OVER (PARTITION BY d.song_id ORDER BY d.i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS around, top FROM sd d JOIN s USING (song_id)) WHERE v = largest AND round(v - around - 0.3e0 * top, 9) >= 0 GROUP BY song_id),
pg AS (SELECT song_id, (i - lag(i) OVER (PARTITION BY song_id ORDER BY i)) / {FPS}e0 AS gap FROM (SELECT song_id, unnest(list_reduce(ps, lambda a, p: CASE WHEN p[1] - a[-1] > 4 THEN list_concat(a, p) ELSE a END)) AS i FROM pk)),
ph AS (SELECT *, sum(c) OVER (PARTITION BY song_id) AS total FROM (SELECT song_id, CAST(floor(round((gap - 0.15e0) / ((1.2e0 - 0.15e0) / 60), 9)) AS BIGINT) AS b, count(*) AS c FROM pg WHERE gap > 0.15e0 AND gap < 1.2e0 GROUP BY ALL)),
pt AS (SELECT song_id, 60e0 / (0.15e0 + (b + 0.5e0) * ((1.2e0 - 0.15e0) / 60)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY c DESC, b) AS rn FROM ph WHERE total > 10) WHERE rn <= 3 AND c >= 5),
cd AS (SELECT DISTINCT song_id, round({FOLDED.format("v")}, 2) AS bpm FROM (SELECT song_id, 1200e0 / k AS v FROM ww UNION ALL SELECT song_id, v FROM wo UNION ALL SELECT song_id, v FROM pt)),
cx AS (SELECT song_id, n, mean, list_transform(env, lambda v: v - mean) AS x FROM s WHERE n > 2 AND top > 0), cr AS (SELECT song_id, n, mean, k, list_inner_product(x[k + 1 :], x[: n - k]) AS r FROM (SELECT *, unnest(generate_series(0, least(72, n - 1))) AS k FROM cx)),
ca AS (SELECT song_id, any_value(n) AS n, any_value(mean) AS mean, list(r / CASE WHEN abs(r0) > 1e-9 THEN r0 ELSE 1 END ORDER BY k) AS ac FROM (SELECT *, first_value(r) OVER (PARTITION BY song_id ORDER BY k) AS r0 FROM cr) GROUP BY song_id),
cs AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, bpm) AS rn, count(*) OVER (PARTITION BY song_id) AS n_tempi FROM (SELECT song_id, bpm, {comb_sql("bpm")} AS score FROM cd JOIN ca USING (song_id))),
cf AS (SELECT song_id, bpm, n_tempi FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, i) AS rn FROM (SELECT song_id, i, bpm, n_tempi, {comb_sql("bpm")} AS score FROM (SELECT song_id, i, n_tempi, bpm * (0.97e0 + i * (0.06e0 / 60)) AS bpm FROM (SELECT *, unnest(generate_series(0, 60)) AS i FROM cs WHERE rn = 1)) JOIN ca USING (song_id))) WHERE rn = 1),
al AS (SELECT cs.song_id, min_by(cs.bpm, rn) AS bpm_alt FROM cs JOIN cf USING (song_id) WHERE rn > 1 AND abs(cs.bpm - cf.bpm) > 3 AND abs({FOLDED.format("(cs.bpm * 2)")} - cf.bpm) > 3 AND abs({FOLDED.format("(cs.bpm / 2)")} - cf.bpm) > 3 GROUP BY cs.song_id),
tp AS (SELECT song_id, round(bpm, 2) AS bpm, bpm_alt, CAST(n_tempi AS INTEGER) AS n_tempi FROM cf LEFT JOIN al USING (song_id))"""


@query(f"WITH {PICK_SQL} SELECT * FROM tp")
def tempo_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempo of each song by comb scores over the candidates of three estimators, refined, and an alternative."""
    return tempo.song_tempi(strengths(spark, sf_dir), "song_id", "env", FPS)


def energy_sql(grids: str) -> str:
    """Mean strength at the beats of each grid (song_id, i, j, p, t, fin): every beat meets the frame that it falls in."""
    return f"""SELECT song_id, i, j, any_value(p) AS p, any_value(t) AS t, round(avg(v * (1 - (x - m.i0)) + nv * (x - m.i0)), 9) AS e FROM
(SELECT *, least(CAST(floor(x) AS BIGINT), n - 2) AS f FROM (SELECT *, (t + k * p) * {FPS}e0 AS x FROM (SELECT *, unnest(generate_series(0, CAST(ceil(fin / p) AS BIGINT))) AS k FROM {grids}) WHERE t + k * p < fin)) b
JOIN sn m ON m.s = b.song_id AND m.i0 = b.f GROUP BY song_id, i, j"""


@query(f"""WITH {PICK_SQL}, sn AS (SELECT song_id AS s, i AS i0, v, lead(v) OVER (PARTITION BY song_id ORDER BY i) AS nv FROM sd), g AS (SELECT song_id, bpm, n, mean, (n - 1) / {FPS}e0 AS fin, 60e0 / (bpm * (1 + 0.04e0)) AS low, 60e0 / (bpm * (1 - 0.04e0)) AS high FROM tp JOIN ca USING (song_id)),
g1 AS (SELECT song_id, n, fin, i, low + i * ((high - low) / 59) AS p FROM (SELECT *, unnest(generate_series(0, 59)) AS i FROM g)), g2 AS (SELECT *, j * (p / 24) AS t FROM (SELECT *, unnest(generate_series(0, 23)) AS j FROM g1)),
g3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY e DESC, i, j) AS rn FROM ({energy_sql("g2")})) WHERE rn = 1),
f1 AS (SELECT song_id, n, fin, i, p0 * 0.999e0 + i * ((p0 * 1.001e0 - p0 * 0.999e0) / 19) AS p, t0 FROM (SELECT song_id, n, fin, p AS p0, t AS t0, unnest(generate_series(0, 19)) AS i FROM g3 JOIN g USING (song_id))),
f2 AS (SELECT *, greatest(t0 - 0.02e0, 0) + j * ((t0 + 0.02e0 - greatest(t0 - 0.02e0, 0)) / 19) AS t FROM (SELECT *, unnest(generate_series(0, 19)) AS j FROM f1)),
f3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY e DESC, i, j) AS rn FROM ({energy_sql("f2")})) WHERE rn = 1),
b AS (SELECT g3.song_id, bpm, mean, CASE WHEN f3.e > g3.e THEN f3.p ELSE g3.p END AS p, CASE WHEN f3.e > g3.e THEN f3.t ELSE g3.t END AS t, greatest(f3.e, g3.e) AS e FROM g3 JOIN f3 USING (song_id) JOIN g USING (song_id))
SELECT song_id, bpm, round(p, 9) AS period, round(t % p, 9) AS phase, round(e / mean, 6) AS lock, e / mean >= 2 AS constant FROM b""")
def constant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant beat grid that fits each song best around its tempo, with its lock ratio; 60 periods by 24 phases,
    then 20 by 20 (song_grids' own setting is 240 by 48, then 40 by 40)."""
    g = tempo.song_grids(strengths(spark, sf_dir), "song_id", "env", FPS, coarse=(60, 24), fine=(20, 20))
    return g.select("song_id", "bpm", F.round("period", 9).alias("period"), F.round("phase", 9).alias("phase"), F.round("lock", 6).alias("lock"), "constant")


@query(f"""WITH {NOTES_SQL}, {env_sql("a", "track = 'click'")}, {env_sql("b", "track = 'view'")},
y1 AS (SELECT a.song_id, a.i, coalesce(b.v, 0) AS v, a.v AS u FROM ad a LEFT JOIN bd b ON b.song_id = a.song_id AND b.i = a.i WHERE a.song_id IN (SELECT song_id FROM b)),
y2 AS (SELECT song_id, i, u, 0.5e0 * lag(v, 1, 0) OVER w + v + 0.5e0 * lead(v, 1, 0) OVER w AS v FROM y1 WINDOW w AS (PARTITION BY song_id ORDER BY i)),
y3 AS (SELECT song_id, count(*) AS n, list(u - mu ORDER BY i) AS x, list(v - mv ORDER BY i) AS y FROM (SELECT *, avg(u) OVER (PARTITION BY song_id) AS mu, avg(v) OVER (PARTITION BY song_id) AS mv FROM y2) GROUP BY song_id), c AS (SELECT *, unnest(generate_series(-40, 160)) AS lag FROM y3),
h AS (SELECT song_id, lag, round(CASE WHEN lag >= n OR lag <= -n THEN 0 WHEN lag >= 0 THEN list_inner_product(x[lag + 1 :], y[: n - lag]) ELSE list_inner_product(x[: n + lag], y[1 - lag :]) END, 6) AS height FROM c)
SELECT song_id, CAST(lag AS INTEGER) AS lag, round(height, 4) AS height FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY height DESC, lag) AS rn FROM h) WHERE rn = 1""")
def onset_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset from -2 to 8 s at which views fit clicks best, by cross-correlation of onset strengths."""
    both = strengths(spark, sf_dir, "click", "a").join(strengths(spark, sf_dir, "view", "b"), "song_id")
    return tempo.song_offsets(both, "song_id", "a", "b", -2 * FPS, 8 * FPS).withColumn("height", F.round("height", 4))


@query()
def song_beat_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of each song: its constant grid if there is one, else beats that follow the onsets."""
    got = tempo.song_beats(strengths(spark, sf_dir), "song_id", "env", FPS, coarse=(60, 24), fine=(20, 20))
    return got.select("song_id", "bpm", "bpm_alt", "constant", F.round("lock", 6).alias("lock"), F.posexplode("beats").alias("beat", "at")).withColumn("at", F.round("at", 6))
