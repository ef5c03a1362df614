"""Streaming queries, run until all rows that are there have been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.plans.registry import query
from annotide.plans.sequences import TRIADS
from annotide.streaming.events import anchored_counts, drain, event_stream, windowed_counts
from annotide.streaming.paths import state_store, stream_lagged_paths

WINDOWS_SQL = """SELECT epoch_ms(time_bucket(INTERVAL '{w} hours', ts, TIMESTAMP '1970-01-01')) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
HAVING time_bucket(INTERVAL '{w} hours', any_value(ts), TIMESTAMP '1970-01-01') + INTERVAL '{w} hours' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'"""


@query(WINDOWS_SQL.format(w=6))
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours that are closed when the watermark is two hours behind the last event."""
    return drain(windowed_counts(event_stream(spark, sf_dir), "6 hours", "2 hours"), spark)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events), r AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e),
a AS (SELECT user_id, i, t, t AS anchor FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, r.t, CASE WHEN r.t - a.anchor <= 21600000 THEN a.anchor ELSE r.t END FROM a JOIN r ON r.user_id = a.user_id AND r.i = a.i + 1)
SELECT user_id, anchor, count(*) AS n FROM a GROUP BY user_id, anchor HAVING anchor + 21600000 < (SELECT max(t) FROM e) - 7200000""")
def stream_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of events of a user within six hours of the first that are closed when the watermark is two hours behind
    the last event."""
    e = event_stream(spark, sf_dir).select("user_id", "ts", F.unix_millis("ts").alias("t"))
    return drain(anchored_counts(e, "user_id", "t", 6 * 3600 * 1000, "ts", "2 hours"), spark)


LAG = 6


@query(f"""WITH RECURSIVE e AS (SELECT user_id // 10 AS key, event_id AS row, epoch_us(ts) // 1000 AS t, 1 << CAST((36 + (event_id * 7) % 48) % 12 AS INTEGER) AS mask FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, row) AS k FROM e WHERE t <= (SELECT max(t) FROM e) - 7200000),
x AS (SELECT key, k, t, row, list_transform([{', '.join(map(str, TRIADS))}], lambda s: bit_count(mask & s) * 1.5::DOUBLE - bit_count(mask) * 0.5::DOUBLE) || [-0.5::DOUBLE] AS em FROM m),
f AS (SELECT key, k, em AS score, [0::BIGINT] AS back FROM x WHERE k = 1
  UNION ALL SELECT x.key, x.k, list_transform(list_zip(f.score, x.em), lambda z: greatest(z[1], list_max(f.score) - 1.25) + z[2]), list_transform(f.score, lambda z, s: CASE WHEN z >= list_max(f.score) - 1.25 THEN s ELSE list_position(f.score, list_max(f.score)) END)
  FROM f JOIN x ON x.key = f.key AND x.k = f.k + 1),
b AS (SELECT key, k AS newest, k, CAST(list_position(score, list_max(score)) AS BIGINT) AS s FROM f WHERE k > {LAG}
  UNION ALL SELECT b.key, b.newest, b.k - 1, f.back[b.s] FROM b JOIN f ON f.key = b.key AND f.k = b.k WHERE b.k > b.newest - {LAG})
SELECT b.key, x.t, x.row, CAST(s - 1 AS INTEGER) AS state FROM b JOIN x ON x.key = b.key AND x.k = b.k WHERE b.k = b.newest - {LAG}""")
def stream_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothest triads under each song's events as a stream, told six events later, as far as the watermark two hours
    behind the last event has come."""
    e = event_stream(spark, sf_dir)
    midi = 36 + (F.col("event_id") * 7) % 48
    rows = e.select(F.expr("user_id div 10").alias("key"), "ts", F.unix_millis("ts").alias("t"), F.col("event_id").alias("row"), F.call_function("shiftleft", F.lit(1).cast("long"), (midi % 12).cast("int")).alias("mask"))
    with state_store(spark):
        return drain(stream_lagged_paths(rows, "ts", "2 hours", LAG, 1.25), spark)
