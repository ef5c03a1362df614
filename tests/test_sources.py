"""MIDI files there and back, project JSON, reports, text sources and streams."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from annotide.operators.stateful import anchored_groups
from annotide.sources import midi, readers, sinks
from annotide.streaming.events import anchored_counts, drain


def test_midi_round_trip(spark, tmp_path):
    rows = [(1, 0, 500, 60, 80), (1, 500, 750, 60, 90), (1, 250, 1000, 64, 127), (1, 1000, 1000, 72, 1), (2, 10, 300, 40, 64)]
    notes = spark.createDataFrame(rows, "song_id long, start_ms long, end_ms long, midi int, velocity int")
    for r in sinks.midi_files(notes, ticks_per_beat=500).collect():
        (tmp_path / f"{r.song_id}.mid").write_bytes(bytes(r.content))
    (tmp_path / "broken.mid").write_bytes(b"no midi")
    got = midi.note_rows(midi.read_midi_events(spark, str(tmp_path))).collect()
    back = sorted((int(r.path.rsplit("/", 1)[1][0]), r.start_us, r.end_us, r.midi, r.velocity) for r in got)
    assert back == sorted((s, a * 1000, max(z, a + 1) * 1000, m, v) for s, a, z, m, v in rows)


def test_tempo_changes_and_unended_notes(spark):
    tempo = [("f", 480, 0, 0, 0, "tempo", 0, 500_000, 0), ("f", 480, 0, 1, 480, "tempo", 0, 1_000_000, 0)]
    notes = [("f", 480, 1, 0, 0, "on", 0, 60, 9), ("f", 480, 1, 1, 240, "off", 0, 60, 0), ("f", 480, 1, 2, 480, "on", 0, 60, 9), ("f", 480, 1, 3, 960, "off", 0, 60, 0), ("f", 480, 1, 4, 960, "on", 0, 61, 9)]
    got = midi.note_rows(spark.createDataFrame(tempo + notes, midi.EVENTS)).orderBy("start_us").collect()
    assert [(r.start_us, r.end_us) for r in got] == [(0, 250_000), (500_000, 1_500_000)]


def test_running_status_and_variable_lengths():
    body = bytes([0, 0x90, 60, 64, 0x81, 0x00, 60, 0, 0, 0xC0, 5, 0, 0xB0, 64, 127])
    assert list(midi.track_events(body)) == [(0, "on", 0, 60, 64), (128, "off", 0, 60, 0), (128, "control", 0, 64, 127)]


def test_projects_and_reports(spark):
    s = spark.createDataFrame([(1, 2000, "F", 0.4), (1, -20, "C", 0.9), (1, -90, "G", 0.9), (1, 3000, "N", 0.1)], "song_id long, start_ms long, label string, conf double")
    p = json.loads(sinks.song_projects(s, 120).first().project)
    assert p["timeline"] == [{"time": 0.0, "chord": "C"}, {"time": 2.0, "chord": "F?"}] and p["version"] == 5
    text = sinks.reports(s).first().report
    assert text.index("| 00:03 | N | 0.10 |") < text.index("| 00:02 | F | 0.40 |") and text.count("| F |") == 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text('chords,main_genre\n"<verse_1> C G/B  Am <chorus_1> F",pop\n"Dmin",rock music\n')
    got = sorted(tuple(r) for r in readers.read_chord_tokens(spark, str(tmp_path / "c.csv")).select("main_genre", "pos", "token").collect())
    assert got == [("pop", 0, "C"), ("pop", 1, "G/B"), ("pop", 2, "Am"), ("pop", 3, "F"), ("rock music", 0, "Dmin")]
    with gzip.open(tmp_path / "j.json.gz", "wt") as f:
        json.dump({"a": {"n": 1}, "b": {"n": 2}}, f)
    assert sorted((r.id, r.n) for r in readers.read_keyed_json(spark, str(tmp_path / "j.json.gz"), "n int").collect()) == [("a", 1), ("b", 2)]
    (tmp_path / "t.log").write_text("start\nEPOCH 3 loss 0.5 val_acc 0.25\nEPOCH 4 loss 0.4 val_acc 0.3\n")
    assert [(r.epoch, r.val_acc) for r in readers.read_epochs(spark, str(tmp_path / "t.log")).orderBy("epoch").collect()] == [(3, 0.25), (4, 0.3)]
    df = spark.createDataFrame([(1, "Verse: C G | Am x Fmaj7")], "song_id long, text string")
    got = [tuple(r) for r in readers.pasted_chords(df, beats_per_chord=2, times=2).orderBy("beat").collect()]
    assert got == [(1, b, c) for b, c in zip(range(0, 16, 2), ["C", "G", "Am", "Fmaj7"] * 2)]


def test_streamed_groups_equal_the_closed_batch_groups(spark, tmp_path):
    """Rows come in three batches, out of order by less than the delay, and some far too late."""
    rows = [(k, 1000 * t) for k in (1, 2, 3) for t in range(1000, 1300, 7 + k)]
    stream_rows = [(k, t, t + 15_000 * (t // 1000 % 2)) for k, t in rows]  # when they come
    df = spark.createDataFrame(stream_rows, "k long, t long, at long").withColumn("ts", F.timestamp_millis("t"))
    late = spark.createDataFrame([(1, 5, 10**9), (2, 1_100_001, 10**9)], "k long, t long, at long").withColumn("ts", F.timestamp_millis("t"))
    for part in (df.where("at < 1100000"), df.where("at >= 1100000 and at < 1200000"), df.where("at >= 1200000").unionByName(late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 3
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in drain(anchored_counts(stream, "k", "t", 20_000, "ts", "20 seconds"), spark).collect())
    end = max(t for _, t in rows) - 20_000
    batch = anchored_groups(df, "k", "t", 20_000).where(F.col("anchor") + 20_000 < end)
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 20
