"""Queries of beats against time, pedals and cuts: operators that look past an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.operators.stateful import pedal_spans, spaced_cuts
from annotide.operators.temporal import lerp_join
from annotide.plans.registry import query
from annotide.plans.windows import SEG_SQL, label_segments
from annotide.sources.notes import NOTES_SQL, notes

BEATS_SQL = f"""{NOTES_SQL}, k AS (SELECT song_id, x, CAST(row_number() OVER (PARTITION BY song_id ORDER BY x) - 1 AS DOUBLE) AS y FROM (SELECT DISTINCT song_id, start_ms AS x FROM n WHERE track = 'view'))"""


def line_sql(points: str, t: str, knots: str) -> str:
    """Every point with the piece of its song's line that answers for it."""
    return f"""p AS (SELECT *, row_number() OVER w AS i, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS px, lag(y) OVER w AS py FROM {knots} WINDOW w AS (PARTITION BY song_id ORDER BY x, y)),
q AS (SELECT song_id, i, x, CASE WHEN nx IS NULL AND px IS NOT NULL THEN px ELSE x END AS x0, CASE WHEN nx IS NULL AND px IS NOT NULL THEN py ELSE y END AS y0, coalesce(nx, x) AS x1, coalesce(ny, y) AS y1 FROM p),
r AS (SELECT {points}.*, {t} AS t0, coalesce(max(q.i), 1) AS i FROM {points} LEFT JOIN q ON q.song_id = {points}.song_id AND q.x <= {t} GROUP BY ALL),
v AS (SELECT r.*, CASE WHEN x1 = x0 THEN y0 ELSE y0 + (t0 - x0) * (y1 - y0) / (x1 - x0)::DOUBLE END AS value FROM r JOIN q ON q.song_id = r.song_id AND q.i = r.i)"""


def beat_knots(n: DataFrame) -> DataFrame:
    """song_id, x (ms), y (number from 0) of each song's beats."""
    w = Window.partitionBy("song_id").orderBy("x")
    b = n.where("track = 'view'").select("song_id", F.col("start_ms").alias("x")).distinct()
    return b.select("song_id", "x", (F.row_number().over(w) - 1).cast("double").alias("y"))


@query(f"""WITH {BEATS_SQL}, m AS (SELECT note_id, song_id, start_ms - 400 AS t FROM n), {line_sql("m", "m.t", "k")}
SELECT note_id, round(value, 6) AS beat, CAST(round_even(value * 480, 0) AS BIGINT) AS tick FROM v""")
def time_to_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats and ticks (480 to a beat) of times, straight between beats and on along the first and last one outside."""
    n = notes(spark, sf_dir)
    m = n.select("note_id", "song_id", (F.col("start_ms") - 400).alias("t"))
    at = lerp_join(m, beat_knots(n), ["song_id"], "t", "x", "y", "beat")
    return at.select("note_id", F.round("beat", 6).alias("beat"), F.rint(F.col("beat") * 480).cast("long").alias("tick"))


@query(f"""WITH {NOTES_SQL}, k AS (SELECT song_id, CAST(floor(i * 0.75e0) AS BIGINT) AS x, CAST(t AS DOUBLE) AS y FROM (SELECT song_id, t, row_number() OVER (PARTITION BY song_id ORDER BY t) AS i FROM (SELECT DISTINCT song_id, start_ms AS t FROM n WHERE track = 'view'))),
m AS (SELECT note_id, song_id, CAST(note_id % 400 - 100 AS BIGINT) AS t FROM n), {line_sql("m", "m.t", "k")} SELECT note_id, t AS beat, round(value, 6) AS ms FROM v""")
def beats_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of beats, also of those outside; where a beat has two times, the later one leads on."""
    n = notes(spark, sf_dir)
    w = Window.partitionBy("song_id").orderBy("t")
    b = n.where("track = 'view'").select("song_id", F.col("start_ms").alias("t")).distinct()
    k = b.select("song_id", F.floor(F.row_number().over(w) * 0.75).cast("long").alias("x"), F.col("t").cast("double").alias("y"))
    m = n.select("note_id", "song_id", (F.col("note_id") % 400 - 100).alias("t"))
    return lerp_join(m, k, ["song_id"], "t", "x", "y", "ms").select("note_id", F.col("t").alias("beat"), F.round("ms", 6).alias("ms"))


PEDAL_SQL = f"""{NOTES_SQL}, e AS (SELECT song_id, start_ms // 500 AS i, CAST(sum(amp + 1) AS BIGINT) AS v, bool_or(track = 'error') AS off FROM n GROUP BY ALL),
d AS (SELECT r.song_id, r.i, coalesce(v, 0) AS v, coalesce(off, false) AS off FROM (SELECT song_id, unnest(generate_series(0, max(i))) AS i FROM e GROUP BY song_id) r LEFT JOIN e ON e.song_id = r.song_id AND e.i = r.i),
o AS (SELECT *, v >= 60 AND v > lag(v) OVER (PARTITION BY song_id ORDER BY i) AS onset FROM d),
x AS (SELECT *, min(CASE WHEN off THEN i END) OVER w AS o, min(CASE WHEN v <= 60 THEN i END) OVER w AS q, max(i) OVER (PARTITION BY song_id) AS last FROM o WINDOW w AS (PARTITION BY song_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
y AS (SELECT song_id, i, CASE WHEN o IS NOT NULL AND (q IS NULL OR o <= q + 10) THEN o WHEN q + 10 <= last THEN q END AS fin, CASE WHEN o IS NOT NULL AND (q IS NULL OR o <= q + 10) THEN o WHEN q + 10 <= last THEN q + 10 END AS told FROM x WHERE onset),
z AS (SELECT a.song_id, a.i, a.fin, min(b.i) AS nxt FROM y a LEFT JOIN y b ON b.song_id = a.song_id AND b.i > a.told GROUP BY a.song_id, a.i, a.fin),
s AS (SELECT song_id, i, fin, nxt FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY i) AS rn FROM z) WHERE rn = 1
  UNION ALL SELECT z.song_id, z.i, z.fin, z.nxt FROM s JOIN z ON z.song_id = s.song_id AND z.i = s.nxt)"""


@query(f"WITH RECURSIVE {PEDAL_SQL} SELECT song_id, i AS bgn, fin FROM s WHERE fin IS NOT NULL")
def pedals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedal spans of each song's frames of half a second."""
    e = notes(spark, sf_dir).groupBy("song_id", F.expr("start_ms div 500").alias("i")).agg(F.sum(F.col("amp") + 1).alias("v"), F.bool_or(F.col("track") == "error").alias("off"))
    dense = e.groupBy("song_id").agg(F.max("i").alias("last")).select("song_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i"))
    f = dense.join(e, ["song_id", "i"], "left").select("song_id", "i", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("off", F.lit(False)).alias("off"))
    return pedal_spans(f, "song_id", "i", "v", "off", 60)


@query(f"WITH RECURSIVE {PEDAL_SQL} SELECT song_id, i * 500 AS t, 127 AS value FROM s WHERE fin IS NOT NULL UNION ALL SELECT song_id, fin * 500, 0 FROM s WHERE fin IS NOT NULL")
def pedal_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sustain controller values in time: down where a pedal span begins, up where it ends."""
    s = pedals(spark, sf_dir)
    return s.select("song_id", F.explode(F.array(F.struct((F.col("bgn") * 500).alias("t"), F.lit(127).alias("value")), F.struct((F.col("fin") * 500).alias("t"), F.lit(0).alias("value")))).alias("c")).select("song_id", "c.t", "c.value")


@query(f"""WITH RECURSIVE {SEG_SQL}, sg AS (SELECT song_id, min(t) AS a, max(t) + 1000 AS z, any_value(label) AS label FROM isl GROUP BY song_id, island),
c AS (SELECT sg.song_id, a, z, label, list(DISTINCT start_ms ORDER BY start_ms) AS cuts FROM sg JOIN n ON n.song_id = sg.song_id AND n.track = 'click' AND start_ms > a AND start_ms < z AND z - start_ms >= 400 GROUP BY ALL),
k AS (SELECT song_id, a, z, cuts, 0 AS i, a AS edge, false AS kept FROM c
  UNION ALL SELECT song_id, a, z, cuts, i + 1, CASE WHEN cuts[i + 1] - edge >= 400 THEN cuts[i + 1] ELSE edge END, cuts[i + 1] - edge >= 400 FROM k WHERE i < len(cuts)),
ed AS (SELECT song_id, a, edge AS s FROM k WHERE kept UNION ALL SELECT song_id, a, a FROM sg)
SELECT ed.song_id, s AS start_ms, coalesce(lead(s) OVER (PARTITION BY ed.song_id, ed.a ORDER BY s), z) AS end_ms, label FROM ed JOIN sg ON sg.song_id = ed.song_id AND sg.a = ed.a""")
def split_at_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label segments cut at clicks, where 400 ms are left on both sides; the first cuts of a segment go first."""
    from annotide.operators.temporal import interval_join

    n = notes(spark, sf_dir)
    g = label_segments(n).select("song_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("z"), "label")
    clicks = n.where("track = 'click'").select("song_id", F.col("start_ms").alias("t")).distinct()
    met = interval_join(clicks, g, ["song_id"], 4000, start="a", end="z").where("t > a and z - t >= 400")
    cuts = spaced_cuts(met.select("song_id", "a", "t", F.col("a").alias("begin")), "song_id", "a", "begin", "t", 400)
    edges = g.select("song_id", "a", F.col("a").alias("s")).unionByName(cuts.select("song_id", "a", F.col("t").alias("s")))
    w = Window.partitionBy("song_id", "a").orderBy("s")
    pieces = edges.join(g, ["song_id", "a"]).select("song_id", F.col("s").alias("start_ms"), F.coalesce(F.lead("s").over(w), F.col("z")).alias("end_ms"), "label")
    return pieces
