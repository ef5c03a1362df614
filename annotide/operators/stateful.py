"""Order-dependent operators. Spark deals out and sorts the rows of each key (a song), and a fold reads them as a stream,
holding what it can't tell yet (paths: while they stay apart), or, where an operator looks at all of a key at once, runs of it."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.operators.sequences import gap_islands


def state_notes(frames: DataFrame, by: list[str], i: str, onset: Column, offset: Column, quiet: Column, cap: int) -> DataFrame:
    """by, bgn, fin: notes of an onset/offset state machine over dense frames, by windows alone.

    A note starts at each onset. It ends before the next onset, or else where it falls quiet: at the offset seen until
    then, if the part before it is longer than the part after it, or at the quiet frame; after cap frames or at the
    last frame in any case.
    """
    # the rows that follow, as a running frame over the reverse order: one pass, where an open end would take one for each row
    after = Window.partitionBy(*by).orderBy(F.col(i).desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = lambda flag: F.last(F.when(flag, F.col(i)), ignorenulls=True).over(after)
    f = frames.select(*by, F.col(i).alias("bgn"), onset.alias("_on"), nxt(onset).alias("_nb"), nxt(quiet).alias("_d"), nxt(offset).alias("_o"), F.max(i).over(Window.partitionBy(*by)).alias("_last"))
    f = f.where("_on")
    stop = F.least(F.col("bgn") + cap, F.col("_last"))
    by_offset = (F.col("_o") <= F.col("_d")) & (F.col("_o") - F.col("bgn") > F.col("_d") - F.col("_o"))
    fin = F.when(F.col("_nb") <= F.least(F.coalesce("_d", stop), stop), F.col("_nb") - 1).when(F.col("_d") <= stop, F.when(by_offset, F.col("_o")).otherwise(F.col("_d"))).otherwise(stop)
    return f.select(*by, "bgn", fin.alias("fin"))


def fold_sorted(df: DataFrame, by: str, order: list[str], start: Callable[[], object], schema: str) -> DataFrame:
    """What a fold makes of each key's rows in order. start() gives an object with push(rows), for the next rows of the
    key, and end(); both give a DataFrame or None. No key is held as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, last = None, None
        for b in batches:
            keys = b[by].astype(object).where(b[by].notna(), None).tolist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                outs = []
                if fold is None or keys[a] != last:
                    outs.append(fold.end() if fold is not None else None)
                    fold, last = start(), keys[a]
                outs.append(fold.push(b.iloc[a:z]))
                yield from (o for o in outs if o is not None and len(o))
        out = fold.end() if fold is not None else None
        if out is not None and len(out):
            yield out

    return df.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


class PathFold:
    """The best path (see best_path) of a stream of emissions. As soon as the paths to all states of the last row have a
    row in common, all up to that row is told and forgotten."""

    def __init__(self, hold: int = 4096):
        self.hold = self.look = hold
        self.score: np.ndarray | None = None
        self.back: list[np.ndarray] = []

    def push(self, emissions: np.ndarray, switch: np.ndarray) -> np.ndarray:
        """States of the rows that are settled by now."""
        own = np.arange(emissions.shape[1], dtype=np.int32)
        for e, cost in zip(emissions, switch):
            if self.score is None:
                self.score = e.astype(float)
                self.back.append(own)
                continue
            best = int(self.score.argmax())
            moved = self.score[best] - cost
            self.back.append(np.where(self.score >= moved, own, best).astype(np.int32))
            self.score = np.maximum(self.score, moved) + e
        if len(self.back) < self.look:
            return own[:0]
        at, told = own, own[:0]
        for k in range(len(self.back) - 1, 0, -1):
            at = self.back[k][at]
            if (at == at[0]).all():
                told = self._settled(k, int(at[0]))
                break
        self.look = max(self.hold, 2 * len(self.back))  # while paths stay apart, they are traced at each doubling only
        return told

    def _settled(self, n: int, state: int) -> np.ndarray:
        """The path of the first n rows held, the last of which is in a state."""
        path = np.empty(n, np.int32)
        for k in range(n - 1, -1, -1):
            path[k] = state
            state = self.back[k][state]
        del self.back[:n]
        return path

    def end(self) -> np.ndarray:
        return self._settled(len(self.back), int(self.score.argmax())) if self.back else np.zeros(0, np.int32)


def best_path(emissions: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """States of the path with the largest sum of emissions [t, s] less switch[t] for each change of state into t."""
    t, s = emissions.shape
    back = np.zeros((t, s), np.int32)
    score = emissions[0].astype(float)
    for k in range(1, t):
        best = int(score.argmax())
        moved = score[best] - switch[k]
        back[k] = np.where(score >= moved, np.arange(s), best)
        score = np.maximum(score, moved) + emissions[k]
    path = np.empty(t, np.int32)
    path[-1] = score.argmax()
    for k in range(t - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def triad_states() -> np.ndarray:
    """[25, 12] 0/1 rows: twelve major and twelve minor triads, and silence."""
    rows = np.zeros((25, 12), int)
    for root in range(12):
        rows[root, [root, (root + 4) % 12, (root + 7) % 12]] = 1
        rows[12 + root, [root, (root + 3) % 12, (root + 7) % 12]] = 1
    return rows


def viterbi_segments(masks: DataFrame, by: str, t: str, mask: str, stay: float = 2.0, on_beat: float = 0.5) -> DataFrame:
    """by, t, state (0 to 11 major, 12 to 23 minor, 24 none): the smoothest labelling of 12-bit masks; changing state
    costs less on every fourth row."""
    tones = triad_states()

    class Fold:
        def __init__(self):
            self.path, self.n, self.waiting = PathFold(), 0, []

        def _told(self, states: np.ndarray) -> pd.DataFrame | None:
            if not len(states):
                return None
            keys, times = (np.concatenate([w[i] for w in self.waiting]) for i in (0, 1))
            self.waiting = [(keys[len(states) :], times[len(states) :])]
            return pd.DataFrame({by: keys[: len(states)], t: times[: len(states)], "state": states})

        def push(self, rows: pd.DataFrame) -> pd.DataFrame | None:
            bits = (rows[mask].to_numpy(np.int64)[:, None] >> np.arange(12)) & 1
            emissions = 1.0 * bits @ tones.T - 0.5 * bits @ (1 - tones.T)
            emissions[:, 24] = np.where(bits.sum(1) == 0, 1.0, -0.5)
            switch = np.where(np.arange(self.n, self.n + len(rows)) % 4 == 0, stay * on_beat, stay)
            self.n += len(rows)
            self.waiting.append((rows[by].to_numpy(), rows[t].to_numpy()))
            return self._told(self.path.push(emissions, switch))

        def end(self) -> pd.DataFrame | None:
            return self._told(self.path.end())

    return fold_sorted(masks.select(by, t, mask), by, [t], Fold, f"{by} long, {t} long, state int")


class LatticeFold:
    """The best path through rows of scored candidates (see lattice_path), told as far as all paths agree."""

    def __init__(self, edge: Callable[[dict, dict], float], hold: int = 1024):
        self.edge, self.hold, self.look = edge, hold, hold
        self.last: list[dict] = []
        self.score: list[float] = []
        self.rows: list[tuple] = []
        self.back: list[list[int]] = []

    def push(self, row: tuple, candidates: list[dict]) -> list[tuple]:
        top = max(c["score"] for c in candidates)
        score, back = [], []
        for c in candidates:
            ways = [s + self.edge(p, c) for s, p in zip(self.score, self.last)]
            best = max(range(len(ways)), key=ways.__getitem__) if ways else 0
            score.append((ways[best] if ways else 0.0) + (c["score"] - top))
            back.append(best)
        self.score, self.last = score, candidates
        self.rows.append(row)
        self.back.append(back)
        if len(self.rows) < self.look:
            return []
        at, told = set(range(len(candidates))), []
        for k in range(len(self.rows) - 1, 0, -1):
            at = {self.back[k][j] for j in at}
            if len(at) == 1:
                told = self._settled(k, at.pop())
                break
        self.look = max(self.hold, 2 * len(self.rows))  # while paths stay apart, they are traced at each doubling only
        return told

    def _settled(self, n: int, pick: int) -> list[tuple]:
        out = []
        for k in range(n - 1, -1, -1):
            out.append((*self.rows[k], pick))
            pick = self.back[k][pick]
        del self.rows[:n], self.back[:n]
        return out[::-1]

    def end(self) -> list[tuple]:
        return self._settled(len(self.rows), max(range(len(self.score)), key=self.score.__getitem__)) if self.rows else []


def lattice_path(rows: DataFrame, by: str, t: str, candidates: str, moves: list[float]) -> DataFrame:
    """by, t, pick (number from 0 of the candidate chosen) of the path whose scores, less each row's best, and edges sum
    to most; ties go to the first candidate. candidates: an array of structs with root, sfx and score, not empty. An
    edge is moves[root - previous root modulo 12], and 0 between equal chords."""

    def edge(p: dict, c: dict) -> float:
        return 0.0 if p["root"] == c["root"] and p["sfx"] == c["sfx"] else moves[(c["root"] - p["root"]) % 12]

    class Fold:
        def __init__(self):
            self.path = LatticeFold(edge)

        def _frame(self, told: list[tuple]) -> pd.DataFrame | None:
            return pd.DataFrame(told, columns=[by, t, "pick"]) if told else None

        def push(self, g: pd.DataFrame) -> pd.DataFrame | None:
            return self._frame([r for k, at, c in zip(g[by], g[t], g[candidates]) for r in self.path.push((k, at), [x if isinstance(x, dict) else x.asDict() for x in c])])

        def end(self) -> pd.DataFrame | None:
            return self._frame(self.path.end())

    return fold_sorted(rows.select(by, t, candidates), by, [t], Fold, f"{by} long, {t} long, pick int")


def absorb(lengths: list[int], labels: list[str], least: int) -> tuple[list[int], list[str]]:
    """Segments after the shortest one below least (of equal ones the first) has gone to its longer neighbour (of equal
    ones the earlier), again and again; neighbours of equal label join."""
    size: list[int] = []
    label: list[str] = []
    for n, x in zip(lengths, labels):
        if label and label[-1] == x:
            size[-1] += n
        else:
            size.append(n)
            label.append(x)
    before, after = list(range(-1, len(size) - 1)), [*range(1, len(size)), -1]
    alive = [True] * len(size)
    left = len(size)
    heap = [(n, i) for i, n in enumerate(size)]
    heapq.heapify(heap)

    def unlink(i: int) -> None:
        nonlocal left
        alive[i] = False
        left -= 1
        if before[i] >= 0:
            after[before[i]] = after[i]
        if after[i] >= 0:
            before[after[i]] = before[i]

    while left > 1:
        n, i = heapq.heappop(heap)
        if not alive[i] or size[i] != n:
            continue  # an entry from before it grew
        if n >= least:
            break
        a, z = before[i], after[i]
        into = a if z < 0 or (a >= 0 and size[a] >= size[z]) else z
        size[into] += n
        unlink(i)
        if a >= 0 and z >= 0 and label[a] == label[z]:
            size[a] += size[z]
            unlink(z)
            into = a
        heapq.heappush(heap, (size[into], into))
    kept = [i for i, x in enumerate(alive) if x]
    return [size[i] for i in kept], [label[i] for i in kept]


def absorb_short(segments: DataFrame, by: str, start: str, end: str, label: str, least: int) -> DataFrame:
    """by, start, end, label of contiguous segments after the short ones have gone to their neighbours."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(start)
        sizes, labels = absorb((rows[end] - rows[start]).tolist(), rows[label].tolist(), least)
        ends = rows[start].iloc[0] + np.cumsum(sizes)
        return pd.DataFrame({by: rows[by].iloc[0], start: ends - np.array(sizes), end: ends, label: labels})

    return segments.select(by, start, end, label).groupBy(by).applyInPandas(run, f"{by} long, {start} long, {end} long, {label} string")


def greedy_pairs(a: np.ndarray, b: np.ndarray, tolerance: int) -> list[tuple[int, int]]:
    """Row numbers of sorted times a and b, matched in the order of a to the nearest free b (of equal ones the earlier)."""
    free = np.ones(len(b), bool)
    out = []
    for i, x in enumerate(a):
        lo, hi = np.searchsorted(b, [x - tolerance, x + tolerance + 1])
        open_ = lo + np.nonzero(free[lo:hi])[0]
        if len(open_):
            j = int(open_[np.abs(b[open_] - x).argmin()])
            free[j] = False
            out.append((i, j))
    return out


def anchored_groups(df: DataFrame, by: str, t: str, eps: int) -> DataFrame:
    """by, anchor, n: rows grouped to the first row of a group while they are at most eps after it.

    The anchor does not move with the rows, so this is neither a session window nor a lag test. The sorted times of a key
    stream through a fold that holds the open group's anchor and count alone and looks once for each group's end. Rows
    of null time are in no group.
    """

    class Fold:
        def __init__(self):
            self.key = self.anchor = None
            self.n = 0

        def push(self, rows: pd.DataFrame) -> pd.DataFrame:
            self.key, times = rows[by].iloc[0], rows[t].to_numpy(np.int64)
            out, i = [], 0
            while i < len(times):
                if self.anchor is None:
                    self.anchor, self.n = int(times[i]), 0
                j = int(np.searchsorted(times, self.anchor + eps, "right"))
                self.n, i = self.n + j - i, j
                if i < len(times):
                    out.append((self.anchor, self.n))
                    self.anchor = None
            return self._frame(out)

        def _frame(self, out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({by: [self.key] * len(out), "anchor": [a for a, _ in out], "n": [n for _, n in out]})

        def end(self) -> pd.DataFrame:
            return self._frame([] if self.anchor is None else [(self.anchor, self.n)])

    times = df.select(by, F.col(t).cast("long").alias(t)).where(F.col(t).isNotNull())
    return fold_sorted(times, by, [t], Fold, f"{by} {df.schema[by].dataType.simpleString()}, anchor long, n long")


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by keys, cut so that no run of equal keys is split."""
    held: pd.DataFrame | None = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        last = np.logical_and.reduce([(b[k] == b[k].iloc[-1]).to_numpy() for k in keys])
        cut = len(b) - int(last[::-1].cumprod().sum())
        if cut:
            yield b.iloc[:cut].reset_index(drop=True)
        held = b.iloc[cut:]
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def greedy_match(left: DataFrame, right: DataFrame, by: str, within: str, t: str, key: str, tolerance: int) -> DataFrame:
    """by, within, left_id, right_id, dt of a one-to-one match of rows with equal `within` (a small integer) within the
    tolerance; both sides have by, within, t and key. No match spans a gap above the tolerance, so rows fall into runs
    without one; runs of one side are dropped, and the others stream, many to a batch, through a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["by", "within", "run"]):
            number = (rows[["by", "within", "run"]] != rows[["by", "within", "run"]].shift()).any(axis=1).cumsum().to_numpy() - 1
            side, times = rows["side"].to_numpy(), rows["t"].to_numpy()
            pairs: list[tuple[int, int]] = []
            edges = np.searchsorted(number, np.arange(number[-1] + 2))
            for a, z in zip(edges[:-1], edges[1:]):
                x, y = a + np.flatnonzero(side[a:z] == 0), a + np.flatnonzero(side[a:z] == 1)
                pairs += [(x[i], y[j]) for i, j in greedy_pairs(times[x], times[y], tolerance)]
            if pairs:
                x, y = (rows.iloc[list(p)].reset_index(drop=True) for p in zip(*pairs))
                yield pd.DataFrame({"by": x["by"], "within": x["within"], "left_id": x["key"], "right_id": y["key"], "dt": y["t"] - x["t"]})

    cols = [F.col(by).alias("by"), F.col(within).cast("long").alias("within"), F.col(t).cast("long").alias("t"), F.col(key).cast("long").alias("key")]
    both = left.select(*cols, F.lit(0).alias("side")).unionByName(right.select(*cols, F.lit(1).alias("side")))
    runs = gap_islands(both, ["by", "within"], ["t"], "t", "t", tolerance, "run")
    own = Window.partitionBy("by", "within", "run")
    runs = runs.withColumn("sides", F.max("side").over(own) - F.min("side").over(own)).where("sides = 1").drop("sides")
    dealt = runs.repartition("by", "within", "run").sortWithinPartitions("by", "within", "run", "t", "key")
    got = dealt.mapInPandas(run, f"by {left.schema[by].dataType.simpleString()}, within long, left_id long, right_id long, dt long")
    return got.withColumnsRenamed({"by": by, "within": within})


def pedal_spans(frames: DataFrame, by: str, i: str, value: str, offset: str, threshold: float, tail: int = 10) -> DataFrame:
    """by, bgn, fin: pedal spans of dense frames with a value and a flag for offsets.

    A span begins where the value rises to the threshold or above it while none is open. It ends at the first offset
    after that, which may lie in the tail frames that follow the first frame at or below the threshold, or else at
    this frame, told when the tail is over. The frame that ends a span begins no other one, and a span that is open at the last
    frame is dropped. Only frames that can begin or end something leave Spark.
    """
    w = Window.partitionBy(by).orderBy(i)
    f = frames.select(by, i, (F.col(value) <= threshold).alias("quiet"), F.col(offset).alias("off"), F.coalesce((F.col(value) >= threshold) & (F.col(value) > F.lag(value).over(w)), F.lit(False)).alias("on"), F.max(i).over(Window.partitionBy(by)).alias("last"))
    f = f.withColumn("begins", F.col("quiet") & F.coalesce(~F.lag("quiet").over(w) | F.lag("on").over(w), F.lit(True))).where("on or off or begins")

    class Fold:
        def __init__(self):
            self.bgn = self.quiet = self.key = self.last = None

        def push(self, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            self.key, self.last = rows[by].iloc[0], int(rows["last"].iloc[0])
            for k, on, off, quiet in zip(rows[i].tolist(), rows["on"].tolist(), rows["off"].tolist(), rows["quiet"].tolist()):
                if self.quiet is not None and k > self.quiet + tail:
                    out.append((self.bgn, self.quiet))
                    self.bgn = self.quiet = None
                if self.bgn is None:
                    self.bgn = k if on else None
                    continue
                if quiet and self.quiet is None:
                    self.quiet = k
                if off or (self.quiet is not None and k - self.quiet >= tail):
                    out.append((self.bgn, k if off else self.quiet))
                    self.bgn = self.quiet = None
            return self._frame(out)

        def _frame(self, out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({by: [self.key] * len(out), "bgn": [a for a, _ in out], "fin": [z for _, z in out]})

        def end(self) -> pd.DataFrame:
            return self._frame([(self.bgn, self.quiet)] if self.quiet is not None and self.last >= self.quiet + tail else [])

    return fold_sorted(f.select(by, i, "on", "off", "quiet", "last"), by, [i], Fold, f"{by} {frames.schema[by].dataType.simpleString()}, bgn long, fin long")


def spaced_cuts(cuts: DataFrame, by: str, segment: str, start: str, place: str, least: float) -> DataFrame:
    """by, segment, place of the cuts kept: in order of place within a segment (numbered in order of time), each that is
    at least `least` after the segment's start and after the last one kept."""

    class Fold:
        def __init__(self):
            self.segment, self.edge = None, 0.0

        def push(self, rows: pd.DataFrame) -> pd.DataFrame:
            keep = np.zeros(len(rows), bool)
            for k, (s, a, x) in enumerate(zip(rows[segment].tolist(), rows[start].tolist(), rows[place].tolist())):
                if s != self.segment:
                    self.segment, self.edge = s, a
                if x - self.edge >= least:
                    keep[k], self.edge = True, x
            return rows.loc[keep, [by, segment, place]]

        def end(self) -> None:
            return None

    kind = lambda c: cuts.schema[c].dataType.simpleString()
    return fold_sorted(cuts.select(by, segment, start, place), by, [segment, place], Fold, f"{by} {kind(by)}, {segment} {kind(segment)}, {place} {kind(place)}")


class PitchRuns:
    """Run number of each value of a stream: a new run where a value is off the median of the run's last window values
    by more than most."""

    def __init__(self, most: float, window: int):
        self.most, self.window, self.run = most, window, 0
        self.held: deque[float] = deque()
        self.sorted: list[float] = []

    def push(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(values), np.int32)
        for i, v in enumerate(values.tolist()):
            n = len(self.sorted)
            if n and abs(v - (self.sorted[n // 2] + self.sorted[(n - 1) // 2]) / 2) > self.most:
                self.held.clear()
                self.sorted.clear()
                self.run += 1
            elif n == self.window:
                del self.sorted[bisect_left(self.sorted, self.held.popleft())]
            self.held.append(v)
            insort(self.sorted, v)
            out[i] = self.run
        return out


def pitch_runs(values: np.ndarray, most: float, window: int) -> np.ndarray:
    return PitchRuns(most, window).push(values)


def split_by_pitch(rows: DataFrame, by: str, t: str, value: str, most: float, window: int = 16) -> DataFrame:
    """by, t, run of each row, in the order of t."""

    class Fold:
        def __init__(self):
            self.runs = PitchRuns(most, window)

        def push(self, g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({by: g[by].to_numpy(), t: g[t].to_numpy(), "run": self.runs.push(g[value].to_numpy(float))})

        def end(self) -> None:
            return None

    return fold_sorted(rows.select(by, t, value), by, [t], Fold, f"{by} long, {t} long, run int")
