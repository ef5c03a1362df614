"""Scores, MIDI files and the data source on files made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from annotide.functions import table_functions
from annotide.operators.harmony import candidate_rows
from annotide.sources import midi, midi_source
from annotide.sources.musicxml import read_musicxml, rebarred

SCORE = """<?xml version="1.0" encoding="UTF-8"?>
<score-partwise version="3.1"><part-list><score-part id="P1"/></part-list>
<part id="P1">
 <measure number="1"><attributes><divisions>2</divisions></attributes>
  <note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration></note>
  <note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration></note>
  <note><grace/><pitch><step>D</step><octave>5</octave></pitch></note>
  <note><rest/><duration>3</duration></note>
  <note><pitch><step>B</step><alter>-1</alter><octave>3</octave></pitch><duration>3</duration></note></measure>
 <measure number="2"><attributes><divisions>4</divisions></attributes>
  <note><pitch><step>G</step><octave>4</octave></pitch><duration>20</duration></note></measure>
 <measure number="3"><note><pitch><step>A</step><octave>4</octave></pitch><duration>4</duration></note><note><rest/><duration>2</duration></note></measure>
</part>
<part id="P2"><measure number="1"><note><rest measure="yes"/><duration>4</duration></note></measure></part>
</score-partwise>"""


def test_musicxml(spark, tmp_path):
    (tmp_path / "a.musicxml").write_text(SCORE)
    got = read_musicxml(spark, tmp_path.as_uri())
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == [
        ("P1", 0, 0, 0.0, 1.0, 61), ("P1", 0, 1, 0.0, 1.0, 64), ("P1", 0, 3, 1.0, 1.5, None), ("P1", 0, 4, 2.5, 1.5, 58), ("P1", 1, 0, 0.0, 5.0, 67), ("P1", 2, 0, 0.0, 1.0, 69), ("P1", 2, 1, 1.0, 0.5, None), ("P2", 0, 0, 0.0, 4.0, None),
    ]
    bars = sorted(map(tuple, rebarred(got, 3, 4).select("part", "measure", "seq", "at", "length", "midi").collect()), key=str)
    assert bars == [
        ("P1", 0, 0, 0.0, 1.0, 61), ("P1", 0, 1, 0.0, 1.0, 64), ("P1", 0, 3, 1.0, 1.5, None), ("P1", 0, 4, 2.5, 0.5, 58), ("P1", 1, 0, 3.0, 3.0, 67), ("P1", 2, 0, 6.0, 1.0, 69), ("P1", 2, 1, 7.0, 0.5, None), ("P2", 0, 0, 0.0, 3.0, None),
    ]


def test_rebarred_extends_the_last_chord_and_drops_what_lies_past_the_bar(spark):
    n = spark.createDataFrame([("p", 0, 0, 0.0, 1.0, 60), ("p", 0, 1, 1.0, 0.25, 62), ("p", 0, 2, 1.0, 0.5, 65), ("p", 0, 3, 2.0, 4.0, 67), ("p", 1, 0, 1.99, 3.0, 60)], "part string, measure int, seq int, onset double, length double, midi int")
    got = {(r.measure, r.seq): r.length for r in rebarred(n, 2, 4).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 1.0, (1, 0): 0.125}


def song() -> bytes:
    tracks = [("a", [(0, "on", 0, 60, 90), (100, "control", 0, 64, 127), (480, "off", 0, 60, 0)]), ("b", [(0, "on", 3, 64, 1), (50, "off", 3, 64, 0)])]
    return midi.tracks_bytes(tracks, 480, 400_000, sharps=-3, minor=True)


def test_tracks_round_trip():
    got = [e[2:] for e in midi.file_events("x", song(), strict=True)]
    assert got == [(0, 0, 0, "tempo", 0, 400_000, 0), (1, 0, 0, "on", 0, 60, 90), (1, 1, 100, "control", 0, 64, 127), (1, 2, 480, "off", 0, 60, 0), (2, 0, 0, "on", 3, 64, 1), (2, 1, 50, "off", 3, 64, 0)]


def test_a_file_cut_anywhere_gives_what_stands_before():
    data = song()
    whole = [e for e in midi.file_events("x", data)]
    for n in range(len(data)):
        got = list(midi.file_events("x", data[:n]))
        events = [e for e in got if e[5] != "broken"]
        assert events == whole[: len(events)]
        if n < len(data) and len(events) < len(whole):
            assert got == [] or len(got) > len(events) or n >= 14
        with pytest.raises(midi.Broken) if any(e[5] == "broken" for e in got) else no_error():
            list(midi.file_events("x", data[:n], strict=True))
    assert list(midi.file_events("x", b"RIFF" + data))[0][5] == "broken"


class no_error:
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_data_after_a_broken_track_is_read():
    bad = b"MTrk" + (3).to_bytes(4, "big") + b"\x00\x90\x40"
    good = midi.track_bytes([(5, b"\x90\x40\x50")])
    got = list(midi.file_events("x", midi.head_bytes(1, 2, 96) + bad + good))
    assert [e[2:] for e in got] == [(0, -1, 0, "broken", 0, 0, 0), (1, 0, 5, "on", 0, 64, 80)]


def test_data_source_modes(spark, tmp_path):
    midi_source.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mid").write_bytes(song())
    (tmp_path / "in" / "b.mid").write_bytes(song()[:-6])
    (tmp_path / "in" / "c.mid").write_bytes(b"no music")
    (tmp_path / "in" / "d.txt").write_bytes(b"no file of ours")
    at = (tmp_path / "in").as_uri()
    all_ = spark.read.format("midi").load(at)
    assert all_.where("kind = 'broken'").select("path").distinct().count() == 2 and all_.where("path = 'a.mid'").count() == 6
    assert spark.read.format("midi").option("mode", "dropmalformed").load(at).where("kind = 'broken'").count() == 0
    with pytest.raises(Exception, match="Broken|c.mid|b.mid"):
        spark.read.format("midi").option("mode", "failfast").load(at).count()
    ok = all_.where("path = 'a.mid'").repartition("path").sortWithinPartitions("path", "track", "seq")
    out = (tmp_path / "out").as_uri()
    ok.write.format("midi").mode("append").save(out)
    ok.withColumn("path", F.lit("deep/b.mid")).write.format("midi").mode("append").save(out)
    again = spark.read.format("midi").option("mode", "failfast").load(out)
    key = lambda df, path: sorted(tuple(r)[1:] for r in df.where(F.col("path") == path).collect())
    assert key(again, "a.mid") == key(again, "deep/b.mid") == key(all_, "a.mid")
    ok.withColumn("path", F.lit("only.mid")).write.format("midi").mode("overwrite").save(out)
    assert [r.path for r in spark.read.format("midi").load(out).select("path").distinct().collect()] == ["only.mid"]


def test_data_source_leaves_nothing_of_a_failed_write(spark, tmp_path):
    midi_source.register(spark)
    rows = [("x.mid", 480, 0, 0, 5, "on", 0, 60, 1), ("../y.mid", 480, 0, 0, 5, "on", 0, 60, 1)]
    df = spark.createDataFrame(rows, midi.EVENTS).coalesce(1)
    with pytest.raises(Exception, match="no file of its own"):
        df.write.format("midi").mode("append").save((tmp_path / "out").as_uri())
    assert not list(tmp_path.rglob("*.mid"))


def test_table_function(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([(0b10010001,), (0,), (None,)], "mask int")
    got = spark.sql("SELECT m.mask, c.* FROM {m} m, LATERAL chord_candidates(m.mask, 3) c", m=df).collect()
    best = sorted((r for r in candidate_rows() if r[0] == 0b10010001), key=lambda r: (-r[4], r[1], r[2]))[:3]
    assert [(r.root, r.sfx, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(r[1], r[3], r[4]) for r in best]
    assert spark.sql("SELECT count(*) AS n FROM chord_candidates(145)").first().n == min(8, len([r for r in candidate_rows() if r[0] == 145]))
    for bad in ("chord_candidates('a', 3)", "chord_candidates(1, 0)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {bad}").collect()
