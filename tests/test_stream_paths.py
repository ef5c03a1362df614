"""The stateful stream of smoothest paths against the batch operator."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from annotide.operators.stateful import best_path
from annotide.streaming.events import drain
from annotide.streaming.paths import LagFold, LaggedPaths, lagged_paths, mask_emissions, state_store, stream_lagged_paths


def test_a_lag_as_long_as_the_stream_gives_the_best_path():
    rnd = np.random.default_rng(1)
    e = rnd.integers(0, 6, (60, 5)) / 2
    for n in range(2, 60, 9):
        fold = LagFold(n - 1)
        told = [x for k in range(n) if (x := fold.push((k,), e[k], 1.5))]
        assert told == [(0, int(best_path(e[:n], np.full(n, 1.5))[0]))]


def test_each_row_is_told_lag_rows_later():
    rnd = np.random.default_rng(2)
    e, lag = rnd.integers(0, 6, (80, 5)) / 2, 7
    fold = LagFold(lag)
    told = [x for k in range(80) if (x := fold.push((k,), e[k], 1.0))]
    assert told == [(k - lag, int(best_path(e[: k + 1], np.full(k + 1, 1.0))[k - lag])) for k in range(lag, 80)]


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    """Rows of three keys come in four files in random order within the delay; a row later than the watermark is dropped."""
    rnd = random.Random(3)
    rows = [(k, 1_700_000_000_000 + t, i, rnd.randrange(4096)) for i, (k, t) in enumerate((k, t) for k in (1, 2, 3) for t in sorted(rnd.sample(range(0, 400_000), 60)))]
    schema = "key long, t long, row long, mask long"
    files = [[r for r in rows if r[1] // 100_000 % 4 == q] for q in (0, 1, 2, 3)]
    stamp = F.timestamp_millis("t").alias("ts")
    for q, part in enumerate(files):
        rnd.shuffle(part)
        spark.createDataFrame(part + ([(1, 1_700_000_000_000, 999, 1)] if q == 3 else []), schema).select("*", stamp).coalesce(1).write.parquet(str(tmp_path / f"in{q}"))
    for q in range(4):  # files are read in the order in which they were written
        (tmp_path / "all").mkdir(exist_ok=True)
        next((tmp_path / f"in{q}").glob("part-*")).rename(tmp_path / "all" / f"{q}.parquet")
        import os

        os.utime(tmp_path / "all" / f"{q}.parquet", (1_700_000_000 + q, 1_700_000_000 + q))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    with state_store(spark):
        got = drain(stream_lagged_paths(stream, "ts", "20 seconds", 5, 1.25), spark)
    last = max(r[1] for r in rows) - 20_000
    batch = lagged_paths(spark.createDataFrame([r for r in rows if r[1] <= last], schema), "key", "t", "row", "mask", 5, 1.25)
    want = sorted(map(tuple, batch.collect()))
    assert want and sorted(map(tuple, got.select("key", "t", "row", "state").collect())) == want


def test_silence_is_its_own_state():
    assert mask_emissions(0).argmax() == 24 and mask_emissions(0b10010001).argmax() == 0


def test_rows_wait_as_batches_of_their_key():
    """A key's rows are kept and read as one value for each batch that they came in, not one for each row; a key whose
    rows all wait gives none, and rows of one time go by their number."""
    kept = []

    class State:
        def __init__(self, value=None):
            self.value = value

        exists = lambda self: self.value is not None
        get = lambda self: iter(self.value) if isinstance(self.value, list) else self.value
        update = put = lambda self, v: setattr(self, "value", v)

        def appendValue(self, v):
            kept.append(v)
            self.value = [*(self.value or []), v]

        def clear(self):
            self.value = None

    class Handle:
        getValueState = getListState = lambda self, name, schema: State()
        registerTimer = lambda self, t: timers.append(t)

    class Now:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    timers = []
    rnd = np.random.default_rng(4)
    n, lag = 9000, 6
    rows = pd.DataFrame({"t": rnd.integers(1, 3000, n), "row": rnd.permutation(n), "mask": rnd.integers(0, 4096, n)})
    path = LaggedPaths(lag, 1.25)
    path.init(Handle())
    assert not list(path.handleInputRows((7,), iter([rows[:5000], rows[5000:]]), Now(0)))
    assert len(kept) == 2 and timers == [rows.t.min()]
    got = [pd.concat(path.handleExpiredTimer((7,), Now(now), None)) for now in (1000, 3000)]
    assert not list(path.handleExpiredTimer((7,), Now(4000), None)) and not path.waiting.exists()
    rows = rows.sort_values(["t", "row"])
    fold = LagFold(lag)
    want = [x for r in zip(rows.t, rows.row, rows["mask"]) if (x := fold.push(r[:2], mask_emissions(r[2]), 1.25))]
    assert list(pd.concat(got)[["t", "row", "state"]].itertuples(index=False, name=None)) == want
