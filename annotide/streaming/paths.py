"""Smoothest paths of streams with a fixed lag: value state, list state and timers by transformWithState."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annotide.operators.stateful import fold_sorted, triad_states

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PORTION = 4096  # rows whose scores are held at once


class LagFold:
    """The best path so far, told for each row once lag more rows are there: its state is that of the row on the best path
    to the newest one. What is held is a score for each state and lag rows of pointers."""

    def __init__(self, lag: int, score: np.ndarray | None = None, back: np.ndarray | None = None):
        self.lag, self.score, self.back = lag, score, back
        self.rows: list[tuple] = []

    def states(self, emissions: np.ndarray, switch: float) -> np.ndarray:
        """The states of the rows that can be told now, after rows of these emissions: each time the oldest ones not told."""
        told = [self._states(emissions[k : k + PORTION].astype(float), switch) for k in range(0, len(emissions), PORTION)]
        return np.concatenate([np.zeros(0, np.int32), *told])

    def _states(self, emissions: np.ndarray, switch: float) -> np.ndarray:
        own = np.arange(emissions.shape[1], dtype=np.int32)
        if self.score is None:
            scores, back, rest = emissions[:1], [own[None]], emissions[1:]
        else:
            scores, back, rest = self.score[None], [self.back], emissions
        scores = np.concatenate([scores, np.empty(rest.shape)])
        for before, now, e in zip(scores, scores[1:], rest):
            np.maximum(before, before[before.argmax()] - switch, out=now)
            now += e
        best = scores.argmax(1).astype(np.int32)
        moved = scores.max(1) - switch
        back = np.concatenate([*back, np.where(scores >= moved[:, None], own, best[:, None])[:-1]])
        self.score, self.back = scores[-1].copy(), back[max(len(back) - self.lag, 0) :]
        newest = np.arange(max(self.lag, len(back) - len(emissions)), len(back))
        state = best[newest - len(back)]
        for k in range(self.lag):
            state = back[newest - k, state]
        return state

    def push(self, row: tuple, emissions: np.ndarray, switch: float) -> tuple | None:
        """The row of lag rows ago with its state."""
        self.rows.append(row)
        states = self.states(emissions[None], switch)
        return (*self.rows.pop(0), int(states[0])) if len(states) else None


def mask_emissions(mask: int | np.ndarray) -> np.ndarray:
    """What the 25 triad states make of 12-bit masks; silence is none of pitch classes."""
    mask = np.asarray(mask)
    bits = ((mask[..., None] >> np.arange(12)) & 1).astype(float)
    tones = triad_states()
    e = bits @ tones.T - 0.5 * (bits @ (1 - tones).T)
    e[..., 24] = np.where(mask == 0, 1.0, -0.5)
    return e


def lagged_paths(masks: DataFrame, by: str, t: str, row: str, mask: str, lag: int, switch: float) -> DataFrame:
    """by, t, row, state of all but the last lag rows of each key, in the order of t and row: the batch operator."""

    class Fold:
        def __init__(self):
            self.fold, self.held = LagFold(lag), []

        def push(self, g: pd.DataFrame) -> pd.DataFrame | None:
            states = self.fold.states(mask_emissions(g[mask].to_numpy(np.int64)), switch)
            rows = pd.concat([*self.held, g[[by, t, row]]], ignore_index=True)
            self.held = [rows[len(states) :]]
            return rows[: len(states)].assign(state=states) if len(states) else None

        def end(self) -> None:
            return None

    return fold_sorted(masks.select(by, t, row, mask), by, [t, row], Fold, f"{by} long, {t} long, {row} long, state int")


class LaggedPaths(StatefulProcessor):
    """Rows wait until the watermark has passed them and are then taken in order, so it does not matter in which batch
    they came. They wait as they came, a batch of a key's rows as one value, and are read when the timer at the earliest
    of them ends."""

    def __init__(self, lag: int, switch: float):
        self.lag, self.switch = lag, switch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.path = handle.getValueState("path", "score binary, back binary, rows binary")
        self.due = handle.getValueState("due", "t long")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for b in rows:
            new = b[["t", "row", "mask"]].to_numpy(np.int64)
            if len(new):
                self.waiting.appendValue((new.tobytes(),))
                first = int(new[:, 0].min()) if first is None else min(first, int(new[:, 0].min()))
        now = timerValues.getCurrentWatermarkInMs()
        if first is not None and first <= now:
            yield from self._passed(key[0], now)
        elif first is not None and not (self.due.exists() and self.due.get()[0] <= first):
            self._wait_for(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.due.exists() and self.due.get()[0] <= now:
            yield from self._passed(key[0], now)

    def _wait_for(self, t: int) -> None:
        self.due.update((t,))
        self.handle.registerTimer(t)

    def _passed(self, key: int, now: int) -> Iterator[pd.DataFrame]:
        waiting = np.concatenate([np.frombuffer(w[0], np.int64).reshape(-1, 3) for w in self.waiting.get()])
        passed, waiting = waiting[waiting[:, 0] <= now], waiting[waiting[:, 0] > now]
        passed = passed[np.lexsort(passed.T[::-1])]
        fold, rows = LagFold(self.lag), passed[:, :2]
        if self.path.exists():
            score, back, held = self.path.get()
            score = np.frombuffer(score)
            fold = LagFold(self.lag, score, np.frombuffer(back, np.int32).reshape(-1, len(score)))
            rows = np.concatenate([np.frombuffer(held, np.int64).reshape(-1, 2), rows])
        states = fold.states(mask_emissions(passed[:, 2]), self.switch)
        self.path.update((fold.score.tobytes(), fold.back.tobytes(), rows[len(states) :].tobytes()))
        if len(waiting):
            self.waiting.put([(waiting.tobytes(),)])
            self._wait_for(int(waiting[:, 0].min()))
        else:
            self.waiting.clear()
            self.due.clear()
        if len(states):
            yield pd.DataFrame({"key": key, "t": rows[: len(states), 0], "row": rows[: len(states), 1], "state": states})

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """List state and timers need the RocksDB store; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def stream_lagged_paths(rows: DataFrame, ts: str, delay: str, lag: int, switch: float) -> DataFrame:
    """key, t, row, state of a stream of rows (key, t in milliseconds of ts, row, mask), each once the watermark has passed
    the row lag rows later; what was later than the watermark when it came is dropped. Start it within state_store."""
    timed = rows.withWatermark(ts, delay).groupBy("key")
    return timed.transformWithStateInPandas(LaggedPaths(lag, switch), "key long, t long, row long, state int", "Append", "EventTime")
