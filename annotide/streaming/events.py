"""Event streams: windowed counts with late data, and anchored groups kept as state until the watermark closes them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 16) -> DataFrame:
    """The files of a table as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet*").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; rows later than the delay are dropped, closed windows come out once."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


def anchored_counts(events: DataFrame, by: str, t: str, eps: int, ts: str, delay: str) -> DataFrame:
    """by, anchor, n: groups as those of the batch operator, each once the watermark on ts is past its end.

    t is ts in milliseconds. Rows are held until the watermark has passed them and are then taken in the order of t,
    so it does not matter in which batch they came; rows that the watermark had passed when they came are dropped. The
    state of a key is its open group and the rows of the last delay; it ends with the group.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, n, waiting = state.get if state.exists else (None, 0, [])
        now = state.getCurrentWatermarkMs() or -1  # 0 before the first batch has ended
        waiting = sorted([*waiting, *(int(v) for b in batches for v in b[t].tolist() if v > now)]) if not state.hasTimedOut else list(waiting)
        closed = []
        passed = [x for x in waiting if x <= now]
        waiting = waiting[len(passed) :]
        for x in passed:
            if anchor is not None and x - anchor <= eps:
                n += 1
            else:
                if anchor is not None:
                    closed.append((key[0], anchor, n))
                anchor, n = x, 1
        if anchor is not None and anchor + eps < now:
            closed.append((key[0], anchor, n))
            anchor, n = None, 0
        if anchor is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((anchor, n, waiting))
            state.setTimeoutTimestamp(min(([] if anchor is None else [max(anchor + eps, now + 1)]) + waiting[:1]))
        yield pd.DataFrame(closed, columns=[by, "anchor", "n"])

    timed = events.withWatermark(ts, delay).select(by, t, ts)
    return timed.groupBy(by).applyInPandasWithState(run, f"{by} long, anchor long, n long", "anchor long, n long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the session's shared one; a temporary one only for local[...] sessions without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="annotide-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream appends until all that is there now has been read, from files in the shared folder."""
    at = shared_folder(spark, "stream")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
