"""Operators on hand-made rows: edges of intervals, ties, single rows, and plain versions of the stateful ones."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotide.operators import stateful
from annotide.operators.harmony import candidate_rows, mask_candidates
from annotide.operators.sequences import forward_fill, gap_islands, islands, sliding_median
from annotide.operators.stateful import anchored_groups
from annotide.operators.temporal import asof_join, interval_join, near_join, overlap_join, top_k

INTERVALS = [(1, 0, 10, "a"), (1, 10, 20, "b"), (1, 5, 5, "none"), (1, 0, 10, "twin"), (1, 3, 100, "long"), (2, 0, 4, "other")]


@pytest.fixture(scope="module")
def intervals(spark):
    return spark.createDataFrame(INTERVALS, "song_id long, start_ms long, end_ms long, name string")


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_interval_join_edges(spark, intervals, bucket):
    probes = [(s, t) for s in (1, 2, 3) for t in (-1, 0, 3, 5, 9, 10, 19, 20, 99, 100)]
    got = interval_join(spark.createDataFrame(probes, "song_id long, t long"), intervals, ["song_id"], bucket)
    want = sorted((s, t, n) for (s, t), (k, a, z, n) in itertools.product(probes, INTERVALS) if s == k and a <= t < z)
    assert sorted(tuple(r) for r in got.select("song_id", "t", "name").collect()) == want
    left = interval_join(spark.createDataFrame(probes, "song_id long, t long"), intervals, ["song_id"], bucket, how="left")
    assert left.where("name is null").count() == len(probes) - len({(s, t) for s, t, _ in want})


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_overlap_join_gives_each_pair_once(intervals, bucket):
    a = intervals.select("song_id", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"), F.col("name").alias("x"))
    b = intervals.select("song_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("name").alias("y"))
    want = sorted((m, n, min(z, w) - max(p, q)) for (s, p, z, m), (t, q, w, n) in itertools.product(INTERVALS, INTERVALS) if s == t and min(z, w) > max(p, q))
    assert sorted(tuple(r) for r in overlap_join(a, b, ["song_id"], bucket).select("x", "y", "overlap").collect()) == want


def test_joins_plan_as_hash_or_merge_joins(spark, intervals, capsys):
    probes = spark.range(100).select(F.lit(1).cast("long").alias("song_id"), F.col("id").alias("t"))
    interval_join(probes, intervals, ["song_id"], 10).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 0), (1, 5), (1, 10), (1, 11), (2, 7), (1, 5)], "song_id long, t long")
    right = spark.createDataFrame([(1, 5, "x"), (1, 10, None), (3, 0, "z")], "song_id long, t long, v string")
    got = sorted((tuple(r) for r in asof_join(left, right, ["song_id"], "t", ["v"]).collect()), key=str)
    assert got == sorted([(1, 0, None), (1, 5, "x"), (1, 5, "x"), (1, 10, None), (1, 11, None), (2, 7, None)], key=str)


def test_near_join(spark):
    a = spark.createDataFrame([(1, t) for t in (0, 10, 20, 30)], "song_id long, x long")
    b = spark.createDataFrame([(1, t) for t in (3, 17, 24)], "song_id long, y long")
    for tol in (0, 3, 4, 100):
        want = sorted((x, y) for x in (0, 10, 20, 30) for y in (3, 17, 24) if abs(x - y) <= tol)
        assert sorted((r.x, r.y) for r in near_join(a, b, ["song_id"], tol, "x", "y").collect()) == want
        assert near_join(a, b, ["song_id"], tol, "x", "y", "left_anti").count() == 4 - len({x for x, _ in want})


def test_top_k_breaks_ties_by_the_whole_order(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "c")], "k long, s long, n string")
    assert [r.n for r in top_k(df, ["k"], [F.col("s").desc(), F.col("n")], 2).orderBy("rank").collect()] == ["a", "b"]


def test_islands_and_fills(spark):
    rows = [(1, i, x) for i, x in enumerate(["a", "a", None, None, "a", "b"])] + [(2, 0, None)]
    df = spark.createDataFrame(rows, "k long, i long, x string")
    got = {(r.k, r.i): r.island for r in islands(df, ["k"], ["i"], F.col("x")).collect()}
    assert [got[1, i] for i in range(6)] == [1, 1, 2, 2, 3, 4] and got[2, 0] == 1
    filled = {(r.k, r.i): r.f for r in forward_fill(df, ["k"], ["i"], "x", "f").collect()}
    assert [filled[1, i] for i in range(6)] == ["a", "a", "a", "a", "a", "b"] and filled[2, 0] is None
    gaps = spark.createDataFrame([(1, 0, 10), (1, 12, 20), (1, 23, 25)], "k long, s long, e long")
    assert [r.island for r in gap_islands(gaps, ["k"], ["s"], "s", "e", 2).orderBy("s").collect()] == [1, 1, 2]


def test_sliding_median(spark):
    v = [5.0, 1.0, 9.0, 2.0, 8.0, 8.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k long, i long, v double")
    got = [r.m for r in sliding_median(df, ["k"], ["i"], "v", 3, "m").orderBy("i").collect()]
    assert got == [float(np.median(v[max(0, i - 1) : i + 2])) for i in range(6)]


def test_anchored_groups_are_no_sessions(spark):
    times = [0, 7, 14, 15, 21, 40]
    df = spark.createDataFrame([(1, t) for t in times] + [(2, 3)], "k long, t long")
    got = sorted(tuple(r) for r in anchored_groups(df, "k", "t", 10).collect())
    assert got == [(1, 0, 2), (1, 14, 3), (1, 40, 1), (2, 3, 1)]


def test_chord_scores(spark):
    rows = [r for r in candidate_rows() if r[0] == (1 << 0 | 1 << 4 | 1 << 7)]
    assert max(rows, key=lambda r: (r[4], -r[1], -r[2]))[1:4:2] == (0, "")
    best = {r["mask"]: (r["root"], r["sfx"]) for r in mask_candidates(spark, 1).collect()}
    assert len(best) == len({r[0] for r in candidate_rows()}) and best[1 << 9 | 1 << 0 | 1 << 4] == (9, "m")


def brute_path(e, switch):
    t, s = e.shape
    return max(itertools.product(range(s), repeat=t), key=lambda p: sum(e[i, p[i]] for i in range(t)) - sum(switch[i] for i in range(1, t) if p[i] != p[i - 1]))


def test_best_path():
    rng = np.random.default_rng(1)
    for _ in range(20):
        e, w = rng.random((5, 3)), rng.random(5)
        p, b = stateful.best_path(e, w), brute_path(e, w)
        total = lambda q: sum(e[i, q[i]] for i in range(5)) - sum(w[i] for i in range(1, 5) if q[i] != q[i - 1])
        assert abs(total(p) - total(b)) < 1e-9


def test_absorb():
    assert stateful.absorb([5, 1, 4], ["a", "b", "c"], 2) == ([6, 4], ["a", "c"])
    assert stateful.absorb([4, 1, 5], ["a", "b", "c"], 2) == ([4, 6], ["a", "c"])
    assert stateful.absorb([5, 1, 4], ["a", "b", "a"], 2) == ([10], ["a"])
    assert stateful.absorb([1, 1], ["a", "b"], 5) == ([2], ["b"])
    assert stateful.absorb([3], ["a"], 5) == ([3], ["a"])


def test_greedy_pairs():
    assert stateful.greedy_pairs(np.array([0, 5, 9]), np.array([4, 6]), 5) == [(0, 0), (1, 1)]
    assert stateful.greedy_pairs(np.array([5]), np.array([4, 6]), 5) == [(0, 0)]
    assert stateful.greedy_pairs(np.array([5]), np.array([50]), 5) == []


def plain_notes(onset, offset, quiet, cap):
    out, bgn, gone, off = [], None, None, None
    for i in range(len(onset)):
        if onset[i]:
            if bgn is not None:
                out.append((bgn, i - 1))
            bgn, gone, off = i, None, None
        elif bgn is not None:
            if quiet[i] and gone is None:
                gone = i
            if offset[i] and off is None:
                off = i
            if gone is not None:
                out.append((bgn, off if off is not None and off - bgn > gone - off else gone))
                bgn = None
        if bgn is not None and (i - bgn >= cap or i == len(onset) - 1):
            out.append((bgn, i))
            bgn = None
    return out


def test_state_notes(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for k in range(40):
        n = int(rng.integers(1, 30))
        flags = rng.random((3, n)) < np.array([[0.15], [0.2], [0.2]])
        rows += [(k, i, *(bool(f[i]) for f in flags)) for i in range(n)]
        want += [(k, *x) for x in plain_notes(*flags, cap=6)]
    df = spark.createDataFrame(rows, "k long, i long, on boolean, off boolean, quiet boolean")
    got = stateful.state_notes(df, ["k"], "i", F.col("on"), F.col("off"), F.col("quiet"), 6)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_pitch_runs():
    assert stateful.pitch_runs(np.array([60, 60.2, 60.1, 62, 62.1, 60]), 0.6, 16).tolist() == [0, 0, 0, 1, 1, 2]


def test_greedy_match_keeps_values_apart(spark):
    a = spark.createDataFrame([(1, 0, 100, 1), (1, 1, 100, 2), (2, 0, 5, 3), (3, 0, 5, 4)], "song long, pc int, t long, id long")
    b = spark.createDataFrame([(1, 0, 104, 11), (1, 1, 95, 12), (1, 1, 103, 13), (2, 1, 5, 14)], "song long, pc int, t long, id long")
    got = stateful.greedy_match(a, b, "song", "pc", "t", "id", 5)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1, 11, 4), (1, 1, 2, 13, 3)]


def test_long_keys_are_cut_at_gaps(spark):
    rng = np.random.default_rng(19)
    rows = [(1, int(rng.integers(3)), int(t), i, bool(rng.integers(2))) for i, t in enumerate(rng.choice(6000, 600, replace=False))]
    df = spark.createDataFrame(rows, "song long, pc int, t long, id long, side boolean")
    matched = stateful.greedy_match(df.where("side"), df.where("not side"), "song", "pc", "t", "id", 15)
    want = set()
    for pc in range(3):
        a, b = (sorted((t, i) for _, p, t, i, s in rows if p == pc and s == side) for side in (True, False))
        want |= {(pc, a[i][1], b[j][1]) for i, j in stateful.greedy_pairs(np.array([t for t, _ in a]), np.array([t for t, _ in b]), 15)}
    assert {(r.pc, r.left_id, r.right_id) for r in matched.collect()} == want and want
    anchored = anchored_groups(df, "song", "t", 15)
    groups = []
    for t in sorted(r[2] for r in rows):
        if groups and t - groups[-1][1] <= 15:
            groups[-1][2] += 1
        else:
            groups.append([1, t, 1])
    assert sorted(map(list, anchored.collect())) == groups
    for got in (matched, anchored):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan  # streams, with no group held
    assert any("RepartitionByExpression" in x and "run" in x for x in matched._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_paths_of_a_stream_equal_whole_ones():
    rng = np.random.default_rng(6)
    for n in (1, 5, 400):
        emissions, switch = rng.integers(0, 4, (n, 6)) / 2, rng.integers(1, 4, n) / 2
        fold, told = stateful.PathFold(hold=16), []
        for a in range(0, n, 7):
            told.append(fold.push(emissions[a : a + 7], switch[a : a + 7]))
            assert len(fold.back) < 200
        told.append(fold.end())
        assert np.concatenate(told).tolist() == stateful.best_path(emissions, switch).tolist()


def test_absorbing_many_segments_equals_plain_steps():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        lengths, labels = rng.integers(1, 9, n).tolist(), rng.choice(list("abc"), n).tolist()
        plain = []
        for x, k in zip(lengths, labels):
            plain = [*plain[:-1], (plain[-1][0] + x, k)] if plain and plain[-1][1] == k else [*plain, (x, k)]
        while len(plain) > 1 and (m := min(plain, key=lambda s: s[0]))[0] < 5:
            i = plain.index(next(s for s in plain if s[0] == m[0]))
            a, z = plain[i - 1] if i else (-1, ""), plain[i + 1] if i + 1 < len(plain) else (-1, "")
            j = i - 1 if a[0] >= z[0] else i + 1
            plain[j] = (plain[j][0] + plain[i][0], plain[j][1])
            del plain[i]
            plain = [s for k, s in enumerate(plain) if not (k and plain[k - 1][1] == s[1])] if not any(plain[k][1] == plain[k - 1][1] for k in range(1, len(plain))) else [*plain[: i - 1], (plain[i - 1][0] + plain[i][0], plain[i][1]), *plain[i + 1 :]]
        assert stateful.absorb(lengths, labels, 5) == ([s[0] for s in plain], [s[1] for s in plain])


def test_lattice_path_equals_all_paths():
    rng = np.random.default_rng(8)
    moves = (rng.integers(-8, 9, 12) / 4).tolist()
    edge = lambda p, c: 0.0 if p == c else moves[(c["root"] - p["root"]) % 12]
    for n in (1, 2, 6):
        rows = [[{"root": int(rng.integers(12)), "score": float(rng.integers(0, 12)) / 4} for _ in range(rng.integers(1, 4))] for _ in range(n)]
        fold = stateful.LatticeFold(edge, hold=3)
        told = [r for i, c in enumerate(rows) for r in fold.push((i,), c)] + fold.end()
        worth = lambda p: sum(rows[i][j]["score"] for i, j in enumerate(p)) + sum(edge(rows[i - 1][p[i - 1]], rows[i][p[i]]) for i in range(1, n))
        assert [r[0] for r in told] == list(range(n))
        assert worth([r[1] for r in told]) == max(map(worth, itertools.product(*(range(len(c)) for c in rows))))
