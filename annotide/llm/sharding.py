"""Sharding by longest-processing-time scheduling.

Documents of equal text form a group that must stay together. Groups, sorted by bytes, go one by one to the
least-loaded shard through a heap. The heap runs on the driver over few entries: groups that hold a large share of all
bytes or rows one by one, and all others as a histogram over sizes of 10 binary digits (sizes below 1,024 bytes are
exact). Groups of one size are alike, so the schedule only has to say how many of them each shard takes; which ones
follows from their number within the size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.llm._common import Store, text_or_empty
from annotide.llm.quality_rules import let

DIGITS = 10


def take(loads: list[float], size: float, count: int) -> list[int]:
    """How many of count items of one size each shard takes if every item goes to the least-loaded shard, ties to the
    first. Most are dealt at once, up to a level that no heap could leave uneven; the last few go through the heap."""
    n = len(loads)
    taken = np.zeros(n, np.int64)
    at = np.array(loads, float)
    if count > 4 * n and size > 0:
        filled = np.sort(at)
        need = (count - n) * size
        depth = np.concatenate([np.diff(filled) * np.arange(1, n), [np.inf]]).cumsum()
        k = int(np.searchsorted(depth, need))
        level = filled[k] + (need - (depth[k - 1] if k else 0.0)) / (k + 1)
        taken = np.maximum(np.ceil((level - at) / size), 0).astype(np.int64)
        while taken.sum() > count:  # by rounding
            taken[int(taken.argmax())] -= 1
    heap = [(at[s] + size * taken[s], s) for s in range(n)]
    heapq.heapify(heap)
    for _ in range(count - int(taken.sum())):
        load, s = heapq.heappop(heap)
        taken[s] += 1
        heapq.heappush(heap, (load + size, s))
    return taken.tolist()


def lpt(items: list[tuple[int, float, int]], n_shards: int) -> dict[int, list[int]]:
    """Item key -> number of its count pieces for each shard, for (key, size of a piece, count) items: largest first,
    always to the least-loaded shard."""
    loads = [0.0] * n_shards
    placed = {}
    for key, size, count in sorted(items, key=lambda x: (-x[1], x[0])):
        placed[key] = take(loads, size, count)
        loads = [load + size * k for load, k in zip(loads, placed[key])]
    return placed


def size_class(size: Column) -> Column:
    """The size rounded down to DIGITS binary digits."""
    surplus = F.greatest(F.char_length(F.bin(size)) - DIGITS, F.lit(0))
    return let(surplus, lambda s: F.call_function("shiftleft", F.call_function("shiftright", size, s), s))


def numbered(rows: DataFrame, by: list[str], order: list[str], parts: Column, name: str) -> DataFrame:
    """rows with their number from 0 within by, in parts of about equal size by a hash of the order columns."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), parts).cast("int"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    offsets = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(within)).join(offsets, on).withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("long")).drop("_part", "_rn", "_p", "_offset", *(f"_by_{c}" for c in by))


def shard_documents(docs: DataFrame, n_shards: int = 16, heavy_per_shard: int = 64, rows_per_part: int = 50_000) -> DataFrame:
    """Adds size, text_crc32, shard and slot to doc_id.

    size: UTF-8 bytes of the text plus 1 (null text: 1, the same group as the empty text). slot: gapless from 0
    in each shard, in an order that depends on the rows alone; rows equal in every column get neighbouring slots
    in any order. Repeated rows are kept. An empty table gives an empty result. Other columns are ignored,
    whatever their names. Groups of more than 1 / (heavy_per_shard * n_shards) of all bytes or rows are placed one by one.
    """
    spark = docs.sparkSession
    store = Store(spark, "shard")
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    groups = store.put(rows.groupBy("g").agg(F.sum("size").alias("w"), F.count("*").alias("n")))
    total, n_rows = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = heavy_per_shard * n_shards
    is_heavy = (F.col("w") > F.lit(total / limit)) | (F.col("n") > F.lit(max(n_rows / limit, 1)))
    heavy = [(r.g, r.w) for r in groups.where(is_heavy).select("g", "w").collect()]  # 2 * limit at most
    light = groups.where(~is_heavy).withColumn("c", size_class(F.col("w")))
    # at most 512 classes for each doubling of the size
    classes = light.groupBy("c").agg(F.count("*").alias("m"), F.sum("w").alias("w")).collect()
    placed = lpt([((0, g), w, 1) for g, w in heavy] + [((1, r.c), r.w / r.m, r.m) for r in classes], n_shards)
    of_group = spark.createDataFrame([(g, int(np.argmax(placed[0, g]))) for g, _ in heavy], "hg long, heavy_shard int")
    ends = [(r.c, r.m, np.cumsum(placed[1, r.c]).tolist()) for r in classes]
    of_class = spark.createDataFrame(pd.DataFrame(ends, columns=["pc", "m", "ends"]), "pc long, m long, ends array<long>")
    known = F.broadcast(of_group)  # both are bounded by the parameters, not by the corpus

    in_class = light.join(F.broadcast(of_class), F.col("c") == F.col("pc")).select("g", "c", "m", "ends")
    in_class = numbered(in_class, ["c"], ["g"], F.ceil(F.col("m") / rows_per_part), "r")
    light_shard = in_class.select(F.col("g").alias("lg"), F.size(F.filter("ends", lambda e: e <= F.col("r"))).alias("shard"))
    by_group = rows.join(known, F.col("g") == F.col("hg")).select("doc_id", "size", "text_crc32", "g", F.col("heavy_shard").alias("shard"))
    by_class = rows.join(known, F.col("g") == F.col("hg"), "left_anti").join(light_shard, F.col("g") == F.col("lg")).select("doc_id", "size", "text_crc32", "g", "shard")
    placed_rows = store.put(by_group.unionByName(by_class))
    store.drop(groups)
    parts = max(64, -(-n_rows // (n_shards * rows_per_part)))
    return numbered(placed_rows, ["shard"], ["doc_id", "text_crc32", "size", "g"], F.lit(parts), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
