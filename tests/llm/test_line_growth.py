"""What must not grow faster than the lines: chance candidates, pairs of like copies that are measured, shuffle files."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from annotide.llm import _common, line_dedup

SYLLABLES = ["th", "an", "er", "on", "the", "ing", "and", "st", "re", "en", "ha", "nt", "ed", "ou", "ea", "ti", " ", " ", ". "]


def changed(rng, line: str, n: int) -> str:
    s = list(line)
    for _ in range(n):
        at = int(rng.integers(len(s)))
        s[at : at + 1] = [["", "x", "th"[rng.integers(2)] + s[at]][rng.integers(3)]]
    return "".join(s)


def test_unlike_lines_seldom_meet():
    """Lines of the same few syllables: those within the edits meet, and few others do."""
    rng = np.random.default_rng(41)
    lines = ["".join(rng.choice(SYLLABLES, 50))[:90].strip().ljust(60, "z") for _ in range(6000)]
    lines += [changed(rng, s, k % 9).strip() for k, s in enumerate(lines[:300])]
    ids = dict(zip(line_dedup.short_ids(line_dedup.line_ids(pa.array(lines))).tolist(), range(len(lines))))
    keys = list(line_dedup._keyed(8, 10, 20, 4)(iter([pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)])], ["text"])])))
    keys = pa.Table.from_batches(keys).combine_chunks().sort_by("bucket").to_batches()
    met = pa.Table.from_batches(line_dedup._met_by_key(8, 10, 1 << 14)(iter(keys)))
    pairs = {(ids[r["a"]], ids[r["b"]]) for r in met.to_pylist() if r["a"] is not None}
    codes = [line_dedup.code_points(s) for s in lines]
    x, y = np.array(sorted(pairs)).T
    near = line_dedup.within(codes, x, y, 8, 10)
    for k in range(300):
        if lines[k] != lines[6000 + k] and line_dedup.within(codes, np.array([k]), np.array([6000 + k]), 8, 10)[0]:
            assert (k, 6000 + k) in pairs or (6000 + k, k) in pairs
    assert near.sum() > 150 and (~near).sum() < 800


def test_cuts_tell_copies_that_are_too_far():
    """Copies of one line with up to 24 edits: no pair within 8 goes, and of the others most do."""
    rng = np.random.default_rng(43)
    base = "".join(rng.choice(SYLLABLES, 300))[:400]
    lines = [line_dedup.code_points(s[: len(s) - int(rng.integers(4))]) for s in (changed(rng, base, k % 25) for k in range(120))]
    lines += [line_dedup.code_points("".join(rng.choice(SYLLABLES, 9))) for _ in range(5)]  # too short to be cut
    x, y = np.triu_indices(len(lines), 1)
    near = line_dedup.within(lines, x, y, 8)
    left = line_dedup.cuts_allow(lines, x, y, np.full(len(x), 8))
    assert near.sum() > 100 and left[near].all()
    like = np.array([len(s) // 32 for s in lines])
    far = ~near & (like[x] == like[y]) & (like[x] > 2)
    assert far.sum() > 1000 and left[far].mean() < 0.4


def test_written_tables_leave_no_shuffle_files(spark):
    def files() -> set[str]:
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (every.apply(i).getName() for i in range(every.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    store, before, setting = _common.Store(spark, "test"), files(), spark.conf.get(_common.SHUFFLES_GO)
    out = store.put(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    again = store.put(out.join(out.groupBy("k").agg(F.sum("count").alias("n")), "k"))
    assert again.agg(F.sum("n")).first()[0] == 1000 and spark.conf.get(_common.SHUFFLES_GO) == setting
    until = time.time() + 10  # they go in the background
    while len(files() - before) > 1 and time.time() < until:
        time.sleep(0.1)
    assert len(files() - before) <= 1  # that of the sum above
