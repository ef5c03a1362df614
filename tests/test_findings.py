"""Findings of reviews: each test failed before its finding was settled."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from annotide.operators.temporal import interval_join, near_join, overlap_join
from annotide.plans import catalogue
from annotide.sources import midi
from annotide.sources.sinks import midi_files, song_files
from tests.oracle import connection, difference

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def events(spark, tmp_path, rows) -> str:
    """A folder with a table of events of (user_id, milliseconds of the song, event_type, value, k)."""
    at = datetime(2024, 1, 1)
    data = [(i, at + timedelta(hours=ms / 1000), u, kind, float(v), f'{{"k": {k}}}') for i, (u, ms, kind, v, k) in enumerate(rows)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def events_view(sf_dir):
    con = connection("/nowhere")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet/*.parquet')")
    return con


def broadcasts(df) -> bool:
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["offset_scan", "offset_refined"])
def test_offsets_multiply_no_row_that_is_broadcast(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(-2000" not in "".join(line for line in plan.splitlines() if "Generate explode" in line)
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "_b" in line]
    assert joins and all("strategy=merge" in line for line in joins)


def test_joins_of_exploded_rows_are_never_broadcast(spark):
    a = spark.range(1).selectExpr("id as k", "5L as t", "0L as l_start", "9L as l_end")
    b = spark.range(1).selectExpr("id as k", "4L as t2", "0L as start_ms", "9L as end_ms", "0L as r_start", "9L as r_end")
    for df in (interval_join(a, b, ["k"], 4), interval_join(a, b, ["k"], 4, how="left"), overlap_join(a, b, ["k"], 4), near_join(a, b, ["k"], 3, "t", "t2"), near_join(a, b.select("k", "t2"), ["k"], 3, "t", "t2", "left_semi")):
        assert not broadcasts(df) and df.count() == 1


def test_strong_tones_of_silent_slices(spark, tmp_path):
    rows = [(10, 100, "click", 1, 0), (10, 200, "view", 1, 0), (10, 12_000, "click", 1, 0), (10, 12_100, "click", 1, 7), (20, 5, "view", 1, 3)]
    d = events(spark, tmp_path, rows)
    assert difference(QUERIES["strong_tones"](spark, d), events_view(d), SQL["strong_tones"]) == ""


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_of_many_files_come_in_bounded_batches():
    data = midi.tracks_bytes([("a", [(t, "on", 0, 60, 90) for t in range(midi.BATCH)])], 480, 500_000)
    got = [b.num_rows for b in midi.event_batches(e for f in range(3) for e in midi.file_events(str(f), data))]
    assert sum(got) == 3 * (midi.BATCH + 1) and max(got) == midi.BATCH


def test_songs_are_packed_without_a_list_of_their_events(spark):
    rows = [(1, "b", 5, "on", 3, 64, 9), (1, "a", 7, "off", 0, 60, 0), (1, "a", 0, "on", 0, 60, 90), (1, "a", 0, "control", 0, 64, 1), (2, "b", 1, "on", 0, 1, 2)]
    files = song_files(spark.createDataFrame(rows, "song_id long, track string, tick long, kind string, channel int, a int, b int"))
    assert "collect_list" not in plan_of(files)
    tracks = {1: [("a", [(0, "control", 0, 64, 1), (0, "on", 0, 60, 90), (7, "off", 0, 60, 0)]), ("b", [(5, "on", 3, 64, 9)])], 2: [("b", [(1, "on", 0, 1, 2)])]}
    assert {r.song_id: bytes(r.content) for r in files.collect()} == {k: midi.tracks_bytes(t, 480, 500_000) for k, t in tracks.items()}
    notes = midi_files(spark.createDataFrame([(1, 0, 500, 60, 80)], "song_id long, start_ms long, end_ms long, midi int, velocity int"))
    assert "collect_list" not in plan_of(notes) and notes.count() == 1


def odd_events(spark, tmp_path) -> str:
    rows = [(10, 100, "click", 1, 0), (10, 119, "view", 9, 5), (10, 120, "view", 0, 5), (10, 960, "click", 100, 7), (10, 961, "click", 3, 7), (20, 4000, "view", -20, 3), (20, 4100, "view", -40, 3), (30, 50, "view", -20, 3), (40, 0, "click", 5, 1), (40, 30, "click", 5, 1), (40, 90_000, "click", 5, 1)]
    return events(spark, tmp_path, rows)


@pytest.mark.parametrize("name", ["bar_beat_at", "frame_grid", "skyline"])
def test_grids_of_songs_with_odd_spans(spark, tmp_path, name):
    """Notes that end before they start, songs that end before 0, and a long silence."""
    d = odd_events(spark, tmp_path)
    assert difference(QUERIES[name](spark, d), events_view(d), SQL[name]) == ""


def test_beats_and_frames_are_not_sorted(spark, sf_dir):
    for name in ("bar_beat_at", "frame_grid"):
        assert "Window" not in plan_of(QUERIES[name](spark, sf_dir))


def test_skyline_does_not_make_every_step_of_every_note(spark, sf_dir):
    lines = [x for x in plan_of(QUERIES["skyline"](spark, sf_dir)).splitlines() if "Generate explode" in x]
    assert lines and not any("sequence(" in x and "div 50)" in x for x in lines)


def test_settings_of_weights_share_the_rows(spark, sf_dir):
    plan = plan_of(QUERIES["weight_sweep"](spark, sf_dir))
    assert plan.index("Generate explode") < plan.rindex("Aggregate") < plan.index("Relation")


def test_spectra_are_made_once_a_slice_where_they_are_fitted(spark, sf_dir):
    plan = plan_of(QUERIES["candidate_residuals"](spark, sf_dir))
    assert "spectrum" not in plan and "Join" not in plan
