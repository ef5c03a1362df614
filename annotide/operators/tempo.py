"""Tempo, constant beat grid and alignment of series: numpy on one dense series a song, dealt out by Spark.

A series has a value for each frame (of 1 / fps seconds) of a song, so its length follows the song's duration and not
its number of notes; songs are spread over tasks and each is read on its own. Sums that decide which candidate wins
are rounded to nine digits first, and the first of equal ones wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tempi are folded into this range; estimators look at those of the wider one.
FOLD = (70.0, 180.0)
LAGS = (30.0, 320.0)


def series(df: DataFrame, by: str, i: str, value: str, name: str) -> DataFrame:
    """by and name: the values of each song's frames as one array from frame 0 to its last one, zero where there is none."""
    sums = df.where(F.col(i) >= 0).groupBy(by, F.col(i).cast("int").alias("i")).agg(F.sum(value).cast("double").alias("v"))
    sparse = sums.groupBy(by).agg(F.max("i").alias("n"), F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    pairs = F.array_sort(F.map_entries("m"))
    return sparse.select(by, "n", F.transform(pairs, lambda x: x["key"]).alias("i"), F.transform(pairs, lambda x: x["value"]).alias("v")).select(by, F.struct("n", "i", "v").alias(name))


def dense(s) -> np.ndarray:
    out = np.zeros(int(s["n"]) + 1)
    out[np.asarray(s["i"], int)] = s["v"]
    return out


def for_each_song(songs: DataFrame, by: str, columns: list[str], f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """What f makes of the dense series of each song, as rows after the song's key."""
    names = [by, *(x.split()[0] for x in schema.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                got = f(*(None if x is None else dense(x) for x in row[1:]))
                if got:
                    yield pd.DataFrame([(row[0], *g) for g in got], columns=names)

    return songs.select(by, *columns).mapInPandas(run, f"{by} {songs.schema[by].dataType.simpleString()}, {schema}")


def fold_bpm(bpm: float) -> float:
    while bpm < FOLD[0]:
        bpm *= 2
    while bpm > FOLD[1]:
        bpm /= 2
    return bpm


def at(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values of a series at fractional frames, straight between neighbours."""
    k = np.minimum(np.floor(place).astype(int), len(x) - 2)
    w = place - k
    return x[k] * (1 - w) + x[k + 1] * w


def correlation(a: np.ndarray, b: np.ndarray, low: int, high: int) -> np.ndarray:
    """Sums of a[i + lag] * b[i] for the lags from low to high, by Fourier transforms."""
    size = 1 << (len(a) + len(b) - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    lags = np.arange(low, high + 1)
    out = full[lags % size]
    out[(lags >= len(a)) | (lags <= -len(b))] = 0.0
    return out


def autocorrelated(env: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelation of a series less its mean at lags 0 to lags, relative to that at 0."""
    x = env - env.mean()
    ac = correlation(x, x, 0, min(lags, len(env) - 1))
    return ac / (ac[0] if abs(ac[0]) > 1e-9 else 1.0)


def comb_scores(ac: np.ndarray, n: int, fps: float, bpm: np.ndarray) -> np.ndarray:
    """Autocorrelation at one, two and four beats of each tempo, summed; teeth beyond the series of n frames don't count."""
    score = np.zeros(len(bpm))
    for beats in (1, 2, 4):
        lag = 60.0 / bpm * fps * beats
        inside = lag < n - 1
        score[inside] += at(ac, lag[inside])
    return np.round(score, 9)


def window_tempi(env: np.ndarray, fps: float, window: float = 8.0, hop: float = 2.0) -> tuple[float | None, list[float]]:
    """The tempo of the mean autocorrelation of all windows, and the one of each window, under a prior around 120."""
    size = min(round(window * fps), len(env))
    lags = np.arange(int(np.ceil(60 * fps / LAGS[1])), min(int(60 * fps / LAGS[0]), size - 1) + 1)
    if not len(lags):
        return None, []
    begins = np.arange(0, len(env) - size + 1, round(hop * fps))
    w = np.lib.stride_tricks.sliding_window_view(env, size)[begins]
    power = (w * w).sum(1)
    acs = np.stack([(w[:, : size - k] * w[:, k:]).sum(1) for k in lags], 1) / np.where(power > 0, power, 1.0)[:, None]
    bpm = 60 * fps / lags
    prior = -0.5 * np.log2(bpm / 120.0) ** 2
    pick = lambda x: np.round(np.log1p(1e6 * x) + prior, 9).argmax(-1)
    return float(bpm[pick(acs.mean(0))]), [float(x) for x in bpm[pick(acs[power > 0])]]


def peaks(env: np.ndarray, reach: int = 3, around: int = 5, share: float = 0.3, wait: int = 4) -> np.ndarray:
    """Frames that are the largest within reach, stand out of the mean around by a share of the maximum, and are more
    than wait frames after the last one."""
    n = len(env)
    edges = np.concatenate([np.full(reach, -np.inf), env, np.full(reach - 1, -np.inf)])
    largest = np.lib.stride_tricks.sliding_window_view(edges, 2 * reach).max(1)
    sums = np.concatenate([[0.0], np.cumsum(env)])
    lo, hi = np.maximum(np.arange(n) - around, 0), np.minimum(np.arange(n) + around, n)
    mean = (sums[hi] - sums[lo]) / (hi - lo)
    ok = np.flatnonzero((env == largest) & (np.round(env - mean - share * env.max(), 9) >= 0))
    out: list[int] = []
    for i in ok.tolist():
        if not out or i - out[-1] > wait:
            out.append(i)
    return np.array(out, int)


def gap_tempi(env: np.ndarray, fps: float, bins: int = 60, low: float = 0.15, high: float = 1.2) -> list[float]:
    """Tempi of the three most frequent gaps between peaks, each seen five times at least."""
    gaps = np.diff(peaks(env)) / fps
    gaps = gaps[(gaps > low) & (gaps < high)]
    if len(gaps) <= 10:
        return []
    width = (high - low) / bins
    which = np.floor(np.round((gaps - low) / width, 9)).astype(int)
    found, counts = np.unique(which, return_counts=True)
    best = sorted(zip(-counts, found))[:3]
    return [60.0 / (low + (b + 0.5) * width) for c, b in best if -c >= 5]


def tempo_candidates(env: np.ndarray, fps: float) -> list[float]:
    whole, each = window_tempi(env, fps)
    found, counts = np.unique(np.round(each, 1), return_counts=True)
    often = [v for _, v in sorted(zip(-counts, found))[:3]]
    tempi = [*([whole] if whole else []), *often, *gap_tempi(env, fps)]
    return sorted({round(fold_bpm(float(b)), 2) for b in tempi})


def pick_tempo(env: np.ndarray, fps: float) -> tuple[float, float | None, int] | None:
    """The tempo of the best comb score, refined by up to 3 % in 61 steps, the best candidate that is neither near it
    nor its octave, and the number of candidates."""
    tempi = tempo_candidates(env, fps) if len(env) > 2 and env.any() else []
    if not tempi:
        return None
    ac = autocorrelated(env, int(np.ceil(4 * 60 * fps / (FOLD[0] * 0.97))) + 1)
    scores = comb_scores(ac, len(env), fps, np.array(tempi))
    ranked = [tempi[i] for i in np.argsort(-scores, kind="stable")]
    near = ranked[0] * (0.97 + np.arange(61) * (0.06 / 60))
    fine = float(near[comb_scores(ac, len(env), fps, near).argmax()])
    far = lambda c: all(abs(x - fine) > 3 for x in (c, fold_bpm(c * 2), fold_bpm(c / 2)))
    return round(fine, 2), next((c for c in ranked[1:] if far(c)), None), len(tempi)


def fit_grid(env: np.ndarray, fps: float, bpm: float, span: float = 0.04, coarse: tuple[int, int] = (240, 48), fine: tuple[int, int] = (40, 40)) -> tuple[float, float, float]:
    """Period and phase (seconds) of the constant grid of most onset strength near a tempo, and its lock ratio: strength
    on the grid over the mean. Coarse periods and phases first, then fine ones around the best."""
    end = (len(env) - 1) / fps

    def energies(p: float, phases: np.ndarray) -> np.ndarray:
        k = np.arange(int(np.ceil(end / p)) + 1)
        t = phases[:, None] + k[None, :] * p
        inside = t < end
        got = np.where(inside, at(env, np.minimum(t, end) * fps), 0.0).sum(1)
        return np.round(got / np.maximum(inside.sum(1), 1), 9)

    best = (-1.0, 0.0, 0.0)

    def look(p: float, phases: np.ndarray) -> None:
        nonlocal best
        e = energies(p, phases)
        j = int(e.argmax())
        if e[j] > best[0]:
            best = (float(e[j]), p, float(phases[j]))

    low, high = 60.0 / (bpm * (1 + span)), 60.0 / (bpm * (1 - span))
    for i in range(coarse[0]):
        p = low + i * ((high - low) / (coarse[0] - 1))
        look(p, np.arange(coarse[1]) * (p / coarse[1]))
    _, p0, t0 = best
    first, last = max(t0 - 0.02, 0.0), t0 + 0.02
    for i in range(fine[0]):
        look(p0 * 0.999 + i * ((p0 * 1.001 - p0 * 0.999) / (fine[0] - 1)), first + np.arange(fine[1]) * ((last - first) / (fine[1] - 1)))
    e, p, t = best
    return p, t % p, e / (float(env.mean()) or 1.0)


def follow_beats(env: np.ndarray, fps: float, bpm: float, tightness: float = 100.0) -> np.ndarray:
    """Frames of the beats of a tempo that may drift: those whose strengths, in deviations of the series, less tightness
    times the squared logarithm of each gap over the beat's length, sum to most; of equal ways the longest gap. A gap is half a
    beat to two beats long, and the last beat is the best frame (of equal ones the last) of the last two beats' length."""
    period = max(round(60 * fps / bpm), 2)
    lags = np.arange(2 * period, period // 2 - 1, -1)
    cost = tightness * np.log(lags / period) ** 2
    strength = env / (env.std() or 1.0)
    n, far = len(env), 2 * period
    score = np.full(n + far, -np.inf)
    back = np.full(n, -1)
    for t in range(n):
        ways = score[t : t + len(lags)] - cost  # the scores from two beats to half a beat ago
        k = int(ways.argmax())
        if ways[k] > 0:
            back[t] = t - lags[k]
        score[t + far] = strength[t] + max(ways[k], 0.0)
    at = int(n - 1 - score[far:][::-1][:far].argmax())
    out = []
    while at >= 0:
        out.append(at)
        at = int(back[at])
    return np.array(out[::-1])


def beat_times(env: np.ndarray, fps: float, least_lock: float = 2.0, **search) -> tuple | None:
    """bpm, bpm_alt, constant, lock and the times of the beats: those of the constant grid if its lock ratio reaches
    least_lock, else those that follow the onsets."""
    got = pick_tempo(env, fps)
    if not got:
        return None
    p, t, lock = fit_grid(env, fps, got[0], **search)
    if lock >= least_lock:
        times = t + np.arange(int(np.ceil(((len(env) - 1) / fps - t) / p))) * p
    else:
        times = follow_beats(env, fps, got[0]) / fps
    return got[0], got[1], lock >= least_lock, lock, [float(x) for x in times]


def song_beats(songs: DataFrame, by: str, env: str, fps: float, **search) -> DataFrame:
    """by, bpm, bpm_alt, constant, lock, beats of each song that has onsets (see beat_times)."""

    def one(x: np.ndarray) -> list[tuple]:
        got = beat_times(x, fps, **search)
        return [got] if got else []

    return for_each_song(songs, by, [env], one, "bpm double, bpm_alt double, constant boolean, lock double, beats array<double>")


def song_tempi(songs: DataFrame, by: str, env: str, fps: float) -> DataFrame:
    """by, bpm, bpm_alt, n_tempi of each song that has onsets."""

    def one(x: np.ndarray) -> list[tuple]:
        got = pick_tempo(x, fps)
        return [got] if got else []

    return for_each_song(songs, by, [env], one, "bpm double, bpm_alt double, n_tempi int")


def song_grids(songs: DataFrame, by: str, env: str, fps: float, least_lock: float = 2.0, **search) -> DataFrame:
    """by, bpm, period, phase, lock, constant of each song that has onsets: the grid around its tempo, and whether its
    lock ratio reaches least_lock; a song whose ratio doesn't has no constant grid, and its beats have to be followed."""

    def one(x: np.ndarray) -> list[tuple]:
        got = pick_tempo(x, fps)
        if not got:
            return []
        p, t, lock = fit_grid(x, fps, got[0], **search)
        return [(got[0], p, t, lock, lock >= least_lock)]

    return for_each_song(songs, by, [env], one, "bpm double, period double, phase double, lock double, constant boolean")


def song_offsets(songs: DataFrame, by: str, a: str, b: str, low: int, high: int) -> DataFrame:
    """by, lag, height: the lag from low to high frames at which series b, moved later by it, goes best with series a.

    b is cut or continued with zeros to the length of a and blurred by halves to both sides, and both are taken less
    their means; height is the sum of products there. Of equal lags the smallest. Songs that lack one of them give none.
    """

    def one(x: np.ndarray | None, y: np.ndarray | None) -> list[tuple]:
        if x is None or y is None:
            return []
        y = np.convolve(np.pad(y[: len(x)], (1, 1 + max(len(x) - len(y), 0))), [0.5, 1.0, 0.5], "valid")
        c = np.round(correlation(x - x.mean(), y - y.mean(), low, high), 6)
        k = int(c.argmax())
        return [(low + k, float(c[k]))]

    return for_each_song(songs, by, [a, b], one, "lag int, height double")
