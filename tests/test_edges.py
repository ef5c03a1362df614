"""Operators that look past an edge: lines through knots, pedals, cuts, matches and paths."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotide.operators import stateful
from annotide.operators.temporal import lerp_join


def line(knots, t):
    """The rule on one sorted list of knots."""
    if not knots:
        return None
    if len(knots) == 1:
        return knots[0][1]
    i = max(sum(x <= t for x, _ in knots) - 1, 0)
    (x0, y0), (x1, y1) = knots[i : i + 2] if i + 1 < len(knots) else knots[i - 1 : i + 1]
    return y0 if x1 == x0 else y0 + (t - x0) * (y1 - y0) / (x1 - x0)


def test_lines_through_knots(spark):
    knots = {1: [(0, 0.0), (10, 1.0), (30, 2.0)], 2: [(5, 3.0)], 3: [(0, 0.0), (0, 2.0), (10, 5.0), (10, 6.0)], 5: [(-5, 1.0), (5, 2.0), (5, 2.5)]}
    times = [-20, -1, 0, 3, 5, 10, 12, 30, 45]
    left = [(k, t) for k in (1, 2, 3, 4, 5) for t in times] + [(1, None), (None, 3)]
    k = spark.createDataFrame([(s, x, y) for s, xs in knots.items() for x, y in xs], "song long, x long, y double")
    df = spark.createDataFrame(left, "song long, t long")
    got = {(r.song, r.t): r.value for r in lerp_join(df, k, ["song"], "t", "x", "y", "value").collect()}
    assert len(got) == len(left)
    for s, t in left:
        want = line(knots.get(s, []), t) if t is not None else None
        assert got[s, t] == (None if want is None else pytest.approx(want)), (s, t)


def test_there_and_back(spark):
    rnd = random.Random(1)
    xs = sorted(rnd.sample(range(1000), 30))
    k = spark.createDataFrame([(1, x, float(i)) for i, x in enumerate(xs)], "song long, x long, y double")
    back = k.select("song", F.col("y").alias("x"), F.col("x").cast("double").alias("y"))
    t = spark.range(-200, 1300, 7).select(F.lit(1).cast("long").alias("song"), F.col("id").cast("double").alias("t"))
    beats = lerp_join(t, k.withColumn("x", F.col("x").cast("double")), ["song"], "t", "x", "y", "beat").withColumnRenamed("t", "was")
    got = lerp_join(beats.withColumnRenamed("beat", "t"), back, ["song"], "t", "x", "y", "again")
    assert got.where("abs(again - was) > 1e-6").count() == 0


def plain_pedals(values, offsets, threshold, tail=10):
    out, bgn, quiet = [], None, None
    for i in range(1, len(values)):
        if values[i] >= threshold and values[i] > values[i - 1] and bgn is None:
            bgn = i
        if bgn is not None and i > bgn:
            if values[i] <= threshold and quiet is None:
                quiet = i
            if offsets[i]:
                out.append((bgn, i))
                bgn = quiet = None
            elif quiet is not None and i - quiet >= tail:
                out.append((bgn, quiet))
                bgn = quiet = None
    return out


def test_pedals_equal_a_loop(spark):
    rnd = random.Random(2)
    songs = {}
    for s in range(40):
        n = rnd.choice([1, 2, 15, 60, 300])
        v, values = rnd.randint(0, 9), []
        for _ in range(n):
            v = rnd.choice([v, v, v, rnd.randint(0, 9), 5])
            values.append(v)
        songs[s] = values, [rnd.random() < rnd.choice([0.0, 0.02, 0.2]) for _ in range(n)]
    df = spark.createDataFrame([(s, i, v, o) for s, (vs, os) in songs.items() for i, (v, o) in enumerate(zip(vs, os))], "song long, i long, v long, off boolean")
    got = sorted(map(tuple, stateful.pedal_spans(df, "song", "i", "v", "off", 5).collect()))
    assert got == sorted((s, *x) for s, (vs, os) in songs.items() for x in plain_pedals(vs, os, 5))


def test_an_offset_in_the_tail_ends_the_span(spark):
    rows = [(1, i, 9 if 2 <= i <= 5 else 0, i == 14) for i in range(40)] + [(2, i, 9 if 2 <= i <= 5 else 0, i == 17) for i in range(40)] + [(3, i, 9 if i >= 2 else 0, False) for i in range(40)]
    df = spark.createDataFrame(rows, "song long, i long, v long, off boolean")
    assert sorted(map(tuple, stateful.pedal_spans(df, "song", "i", "v", "off", 5).collect())) == [(1, 2, 14), (2, 2, 6)]


def test_cuts_equal_a_loop(spark):
    rnd = random.Random(3)
    rows, want = [], []
    for s in range(5):
        for a in range(0, 5000, 1000):
            edge = a
            for x in sorted(rnd.sample(range(a + 1, a + 1000), rnd.randint(0, 12))):
                rows.append((s, a, a, x))
                if x - edge >= 150:
                    want.append((s, a, x))
                    edge = x
    df = spark.createDataFrame(rows, "song long, seg long, begin long, x long").repartition(7)
    assert sorted(map(tuple, stateful.spaced_cuts(df, "song", "seg", "begin", "x", 150).collect())) == want


def plain_match(a, b, tolerance):
    free, out = dict(enumerate(b)), []
    for i, x in enumerate(a):
        near = min(((abs(y - x), j) for j, y in free.items() if abs(y - x) <= tolerance), default=None)
        if near:
            out.append((i, near[1]))
            del free[near[1]]
    return out


def test_matches_stream_many_runs_to_a_batch(spark, monkeypatch):
    """Right over random songs; Python is called by batch, not by run."""
    rnd = random.Random(4)
    left, right, want = [], [], []
    for s in range(3):
        for w in range(4):
            a, b = (sorted(rnd.sample(range(0, 40_000), 120)) for _ in range(2))
            ids = lambda side, k: s * 10_000 + w * 1000 + side * 500 + k
            left += [(s, w, t, ids(0, k)) for k, t in enumerate(a)]
            right += [(s, w, t, ids(1, k)) for k, t in enumerate(b)]
            want += [(s, w, ids(0, i), ids(1, j), b[j] - a[i]) for i, j in plain_match(a, b, 100)]
    schema = "song long, w int, t long, id long"
    df = stateful.greedy_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "song", "w", "t", "id", 100)
    assert sorted(map(tuple, df.collect())) == sorted(want)
    plan = df._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_whole_runs_are_never_split():
    import pandas as pd

    rows = pd.DataFrame({"by": [1] * 7 + [2] * 5 + [3], "run": [1, 1, 1, 2, 2, 3, 3, 1, 1, 1, 1, 1, 4]})
    for size in (1, 2, 3, 5, 13):
        parts = list(stateful.whole_runs(iter([rows.iloc[i : i + size] for i in range(0, len(rows), size)]), ["by", "run"]))
        assert pd.concat(parts)[["by", "run"]].to_numpy().tolist() == rows.to_numpy().tolist()
        edges = [tuple(p.iloc[0]) for p in parts]
        assert len(set(edges)) == len(edges) and all(tuple(p.iloc[-1]) not in edges[i + 1 :] for i, p in enumerate(parts))


def test_paths_that_stay_apart_take_time_in_proportion():
    """Two chords that are tied all along: twice the rows, about twice the time."""

    def took(n: int) -> float:
        fold = stateful.LatticeFold(lambda p, c: 0.0 if p["root"] == c["root"] else -9.0)
        t = time.time()
        told = [r for k in range(n) for r in fold.push((k,), [{"root": 0, "score": 1.0}, {"root": 6, "score": 1.0}])] + fold.end()
        assert [r[1] for r in told] == [0] * n
        return time.time() - t

    took(2000)
    assert took(16_000) < 6 * took(4000) + 0.5


def test_smooth_paths_that_stay_apart():
    fold, n = stateful.PathFold(hold=16), 4000
    e = np.zeros((n, 2))
    e[:, 0] = 1.0
    e[:, 1] = 1.0
    told = [fold.push(e[i : i + 50], np.full(50, 9.0)) for i in range(0, n, 50)] + [fold.end()]
    assert np.concatenate(told).tolist() == stateful.best_path(e, np.full(n, 9.0)).tolist()


def test_anchored_groups_of_a_dense_run_take_time_in_proportion(spark):
    """No gap above eps anywhere, so all of a key is one run; batches of any size give the same groups."""
    n = 300_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 3).alias("t"))
    t = time.time()
    got = stateful.anchored_groups(df, "k", "t", 10).agg(F.count("*"), F.sum("n"), F.max("n"), F.max("anchor")).first()
    assert tuple(got) == (n // 4, n, 4, (n // 4 - 1) * 12) and time.time() - t < 30
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        few = stateful.anchored_groups(df.where("t < 300"), "k", "t", 10)
        assert sorted(map(tuple, few.collect())) == [(1, a, 4) for a in range(0, 300, 12)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert stateful.anchored_groups(df.where("false"), "k", "t", 10).count() == 0
    assert stateful.anchored_groups(spark.createDataFrame([(None, 5), (None, 6), (2, None)], "k long, t long"), "k", "t", 10).collect() == [(None, 5, 2)]


def test_asof_by_buckets_equals_asof(spark):
    """A bucket without right rows takes the last one of an earlier bucket; keys without any, null times and null payloads."""
    from annotide.operators.temporal import asof_join

    rnd = random.Random(9)
    left = [(s, rnd.choice([None, rnd.randint(-50, 2000)]) if i % 9 == 0 else rnd.randint(-50, 2000), i) for s in (1, 2, 3, None) for i in range(80)]
    right = [(s, t, None if t % 5 == 0 else t * 10) for s in (1, 2, None) for t in rnd.sample(range(0, 1500), 12)]
    a, b = spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame(right, "k long, t long, v long")
    want = {}
    for s, t, i in left:
        seen = [(x, v) for r, x, v in right if r == s and t is not None and x <= t]
        want[s, i] = max(seen)[1] if seen else None
    for bucket in (None, 1, 70, 100_000):
        got = asof_join(a, b, ["k"], "t", ["v"], bucket=bucket)
        assert got.columns == ["k", "t", "i", "v"] and {(r.k, r.i): r.v for r in got.collect()} == want
