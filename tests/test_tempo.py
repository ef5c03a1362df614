"""Tempo, grids, offsets and spectra against direct versions."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotide.operators import nnls, tempo


def clicks(bpm: float, first: float, seconds: float, fps: float, noise: float = 0.02, seed: int = 0) -> np.ndarray:
    """Onset strength of a click on each beat, shared by the two frames around it."""
    rnd = np.random.default_rng(seed)
    env = rnd.random(int(seconds * fps) + 1) * noise
    for k in range(int((seconds - first) * bpm / 60)):
        x = (first + k * 60 / bpm) * fps
        i = int(x)
        if i + 1 < len(env):
            env[i] += 1 - (x - i)
            env[i + 1] += x - i
    return env


@pytest.mark.parametrize("bpm", [90.0, 120.0, 128.0, 174.0])
def test_clicks_have_their_tempo_and_grid(bpm):
    env = clicks(bpm, 0.31, 60, 43.0)
    got, alt, n = tempo.pick_tempo(env, 43.0)
    assert abs(tempo.fold_bpm(got) - bpm) < 1.5 or abs(got * 2 - bpm) < 1.5
    p, t, lock = tempo.fit_grid(env, 43.0, bpm)
    assert abs(p - 60 / bpm) < 2e-3 and lock > 2
    off = (t - 0.31) % p
    assert min(off, p - off) < 0.03


def test_noise_has_no_lock():
    env = np.random.default_rng(3).random(3000)
    assert tempo.fit_grid(env, 50.0, 120.0)[2] < 2


def test_silence_and_single_frames_have_no_tempo():
    assert tempo.pick_tempo(np.zeros(100), 20) is None and tempo.pick_tempo(np.ones(2), 20) is None and tempo.pick_tempo(np.array([0, 1.0, 0]), 20) is None


def test_correlation_equals_the_direct_sum():
    rnd = np.random.default_rng(2)
    for n, m in ((50, 50), (7, 31), (40, 3), (1, 1)):
        a, b = rnd.normal(size=n), rnd.normal(size=m)
        want = [sum(a[i + lag] * b[i] for i in range(m) if 0 <= i + lag < n) for lag in range(-60, 61)]
        assert np.allclose(tempo.correlation(a, b, -60, 60), want)


def test_correlation_takes_n_log_n():
    a = np.random.default_rng(2).normal(size=400_000)
    t = time.time()
    tempo.correlation(a, a, -200_000, 200_000)
    assert time.time() - t < 5


def test_comb_teeth_beyond_the_series_do_not_count():
    ac = np.linspace(1, 0, 200)
    assert tempo.comb_scores(ac, 30, 10.0, np.array([60.0]))[0] == pytest.approx(ac[10] + ac[20])


def test_peaks_equal_a_loop():
    rnd = np.random.default_rng(5)
    env = np.round(rnd.random(400) ** 6, 2)
    want, last = [], None
    for i in range(len(env)):
        near, around = env[max(i - 3, 0) : i + 3], env[max(i - 5, 0) : i + 5]
        if env[i] == near.max() and round(env[i] - around.mean() - 0.3 * env.max(), 9) >= 0 and (last is None or i - last > 4):
            want.append(i)
            last = i
    assert tempo.peaks(env).tolist() == want


def test_offset_of_a_moved_series(spark):
    rnd = np.random.default_rng(4)
    x = (rnd.random(500) > 0.9).astype(float)
    rows = [(1, i + 17, float(v), "a") for i, v in enumerate(x)] + [(1, i, float(v), "b") for i, v in enumerate(x)] + [(2, 3, 1.0, "a")]
    df = spark.createDataFrame(rows, "song long, i int, v double, side string")
    a, b = (tempo.series(df.where(F.col("side") == s), "song", "i", "v", s) for s in "ab")
    got = tempo.song_offsets(a.join(b, "song", "left"), "song", "a", "b", -40, 60).collect()
    assert [(r.song, r.lag) for r in got] == [(1, 17)]


def plain_nnls(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active set."""
    x, on = np.zeros(d.shape[1]), np.zeros(d.shape[1], bool)
    while True:
        w = np.where(on, -np.inf, d.T @ (s - d @ x))
        if on.all() or w.max() < 1e-9:
            return x
        on[w.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[on] = np.linalg.lstsq(d[:, on], s, rcond=None)[0]
            if z[on].min() > 0:
                x = z
                break
            bad = on & (z <= 0)
            x = x + (x[bad] / (x[bad] - z[bad])).min() * (z - x)
            on &= x > 1e-12


def test_residuals_equal_a_plain_solver():
    rnd = np.random.default_rng(1)
    d = nnls.dictionary()
    s = np.abs(rnd.normal(size=(60, nnls.BINS))) * rnd.integers(0, 2, (60, nnls.BINS))
    s[:30] = np.maximum(rnd.normal(size=(30, nnls.NOTES)), 0) @ d.T
    s[30] = 0
    masks = rnd.integers(1, 4096, 60)
    masks[31] = 0
    got = nnls.residuals(s, masks)
    for r, x, mask in zip(got, s, masks):
        own = d[:, [n for n in range(nnls.NOTES) if mask >> ((nnls.LOWEST + n) % 12) & 1]]
        if not x.any():
            assert np.isnan(r)
        else:
            assert abs(r - (np.linalg.norm(own @ plain_nnls(own, x) - x) / np.linalg.norm(x) if own.size else 1.0)) < 1e-6


def test_a_chord_explains_itself_best(spark):
    d = nnls.dictionary()
    tones = [48, 52, 55]  # C E G
    spectrum = [float(v) for v in d[:, [t - nnls.LOWEST for t in tones]].sum(1)]
    masks = {"C": 0b10010001, "Am": 0b1000010001, "F": 0b1000100001}
    df = spark.createDataFrame([(k, spectrum, m) for k, m in masks.items()] + [("none", None, 1)], "name string, spectrum array<double>, mask int")
    got = {r["name"]: r["residual"] for r in nnls.explained(df, "spectrum", "mask").collect()}
    assert got["C"] < 1e-9 and min(got["Am"], got["F"]) > 0.2 and got["none"] is None


def plain_beats(env, fps, bpm, tightness=100.0):
    period = max(round(60 * fps / bpm), 2)
    strength = env / (env.std() or 1.0)
    score, back = [], []
    for t in range(len(env)):
        ways = [(score[t - lag] - tightness * np.log(lag / period) ** 2, lag) for lag in range(period // 2, 2 * period + 1) if t - lag >= 0]
        best = max(ways, default=(0.0, 0))
        score.append(strength[t] + max(best[0], 0.0))
        back.append(t - best[1] if best[0] > 0 else -1)
    tail = range(max(len(env) - 2 * period, 0), len(env))
    at, out = max(tail, key=lambda t: (score[t], t)), []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def test_beats_that_follow_equal_a_plain_search():
    rnd = np.random.default_rng(8)
    for bpm, n in ((120.0, 300), (75.0, 150), (170.0, 40), (100.0, 3)):
        env = rnd.random(n) ** 4
        assert tempo.follow_beats(env, 20.0, bpm).tolist() == plain_beats(env, 20.0, bpm)


def test_beats_of_a_drifting_tempo_are_followed():
    fps, t, times = 43.0, 0.5, []
    while t < 80:
        times.append(t)
        t += 0.5 * (1 + 0.06 * np.sin(t / 9))
    env = np.random.default_rng(1).random(int(82 * fps)) * 0.05
    for x in times:
        env[round(x * fps)] += 1.0
    got = tempo.follow_beats(env, fps, 120.0) / fps
    assert sum(np.abs(got - x).min() < 0.04 for x in times) >= 0.95 * len(times) and abs(len(got) - len(times)) < 8


def test_song_beats_choose_the_grid_where_it_locks(spark):
    fps = 43.0
    rows = [(1, i, float(v)) for i, v in enumerate(clicks(120.0, 0.25, 60, fps))] + [(2, i, float(v)) for i, v in enumerate(np.random.default_rng(5).random(1500))]
    env = tempo.series(spark.createDataFrame(rows, "song long, i int, v double"), "song", "i", "v", "env")
    got = {r.song: r for r in tempo.song_beats(env, "song", "env", fps, coarse=(120, 24), fine=(20, 20)).collect()}
    assert got[1].constant and 118.5 <= got[1].bpm <= 121.5 and not got[2].constant
    gaps = np.diff(got[1].beats)
    assert np.allclose(gaps, gaps[0]) and abs(gaps[0] - 0.5) < 2e-3 and len(got[2].beats) > 10


def env_of(rows, fps=20):
    last = max(r.start_ms for r in rows) * fps // 1000
    env = np.zeros(last + 1)
    for r in rows:
        env[r.start_ms * fps // 1000] += r.amp + 1
    return env


def songs_of(spark, sf_dir):
    from annotide.sources.notes import notes

    out: dict[int, list] = {}
    for r in notes(spark, sf_dir).collect():
        out.setdefault(r.song_id, []).append(r)
    return out


def test_query_of_beats_equals_a_plain_search(spark, sf_dir):
    from annotide.plans.tempo import song_beat_times

    got: dict[int, list] = {}
    for r in song_beat_times(spark, sf_dir).orderBy("song_id", "beat").collect():
        got.setdefault(r.song_id, []).append(r)
    songs = songs_of(spark, sf_dir)
    assert set(got) == set(songs)
    for s, rows in songs.items():
        env, own = env_of(rows), got[s]
        bpm = own[0].bpm
        assert [r.beat for r in own] == list(range(len(own)))
        if own[0].constant:
            gaps = np.diff([r["at"] for r in own])
            assert np.allclose(gaps, gaps[0], atol=1e-5) and abs(60 / gaps[0] - bpm) < 0.05 * bpm
        else:
            assert [round(r["at"] * 20) for r in own] == plain_beats(env, 20.0, bpm)


def test_query_of_residuals_equals_a_plain_solver(spark, sf_dir):
    from annotide.plans.spectra import candidate_residuals

    d = nnls.dictionary()
    triads = {(r, m): {(r + v) % 12 for v in ((0, 3, 7) if m else (0, 4, 7))} for r in range(12) for m in (0, 1)}
    slices: dict[tuple, list] = {}
    for s, rows in songs_of(spark, sf_dir).items():
        for r in rows:
            slices.setdefault((s, r.start_ms // 5000), []).append(r)
    got: dict[tuple, list] = {}
    for r in candidate_residuals(spark, sf_dir).collect():
        got.setdefault((r.song_id, r.f), []).append(r)
    assert set(got) == set(slices)
    for key, rows in slices.items():
        mass = {t: sum(r.amp + 1 for r in rows if r.midi % 12 in pcs) for t, pcs in triads.items()}
        best = sorted((t for t in triads if mass[t]), key=lambda t: (-mass[t], t))[:3]
        own = sorted(got[key], key=lambda r: r["rank"])
        assert [((r.root, r.minor), r.mass) for r in own] == [(t, mass[t]) for t in best]
        spectrum = np.zeros(nnls.BINS)
        for r in rows:
            for h in range(1, 9):
                b = (r.midi - 24) * 3 + 1 + round(36 * float(np.log2(h)))
                if b < nnls.BINS:
                    spectrum[b] += (r.amp + 1) * 0.75 ** (h - 1)
        spectrum = np.log1p(10 * spectrum / np.median(spectrum[spectrum > 0]))
        low = min(r.midi for r in rows) % 12
        for r in own if key[1] % 6 == 0 else []:
            cols = d[:, [n for n in range(nnls.NOTES) if (n + 24) % 12 in triads[r.root, r.minor] | {low}]]
            assert abs(r.residual - np.linalg.norm(cols @ plain_nnls(cols, spectrum) - spectrum) / np.linalg.norm(spectrum)) < 2e-6
