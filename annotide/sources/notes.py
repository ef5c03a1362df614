"""Note events: from the events table, with integer milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same projection for DuckDB.
NOTES_SQL = """n AS (SELECT event_id AS note_id, user_id // 10 AS song_id, event_type AS track, start_ms,
  start_ms + CAST(round(value * 50, 0) AS BIGINT) + 250 AS end_ms, CAST(36 + (event_id * 7) % 48 AS INT) AS midi,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS amp, value
  FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 3600000 AS start_ms FROM events))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, song_id, track, start_ms, end_ms, midi, amp (hundredths), value; an hour of events is a second."""
    start = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 3600000")
    e = table(spark, sf_dir, "events").withColumn("start_ms", start)
    return e.select(
        F.col("event_id").alias("note_id"),
        F.expr("user_id div 10").alias("song_id"),
        F.col("event_type").alias("track"),
        "start_ms",
        (F.col("start_ms") + F.round(F.col("value") * 50, 0).cast("long") + 250).alias("end_ms"),
        (36 + (F.col("event_id") * 7) % 48).cast("int").alias("midi"),
        F.get_json_object("props", "$.k").cast("long").alias("amp"),
        "value",
    )
