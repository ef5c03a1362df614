"""Standard MIDI files: raw events by a small byte reader, notes and times by Spark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "path string, ticks_per_beat int, track int, seq int, tick long, kind string, channel int, a int, b int"
NAMES = [f.split()[0] for f in EVENTS.split(", ")]
TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in EVENTS.split(", ")]
#: Rows of a batch of events.
BATCH = 10_000
#: Data bytes of the channel messages by their upper four bits.
CHANNEL_BYTES = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}


class Broken(ValueError):
    """A file that ends within an event, or has data where a status should be."""


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and the place behind it."""
    n = 0
    while True:
        if at >= len(data):
            raise Broken("it ends within a number")
        byte = data[at]
        at += 1
        n = n << 7 | byte & 0x7F
        if byte < 0x80:
            return n, at


def track_events(data: bytes) -> Iterator[tuple[int, str, int, int, int]]:
    """tick, kind (on, off, control, tempo), channel and two values of a track chunk's body; others are passed over.
    Broken where the body ends within an event, after the events before it."""
    at, tick, status = 0, 0, 0
    while at < len(data):
        delta, at = _number(data, at)
        tick += delta
        if at < len(data) and data[at] >= 0x80:
            status = data[at]
            at += 1
        if status == 0xFF:
            meta = data[at] if at < len(data) else 0
            size, at = _number(data, at + 1)
            if at + size > len(data):
                raise Broken("it ends within an event")
            if meta == 0x51:
                yield tick, "tempo", 0, int.from_bytes(data[at : at + size], "big"), 0
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _number(data, at)
            at += size
        else:
            size = CHANNEL_BYTES.get(status >> 4, 0)
            if not size or at + size > len(data):
                raise Broken("it ends within an event" if size else "data without a status")
            a, b = (data[at], data[at + 1] if size == 2 else 0)
            at += size
            kind = {0x8: "off", 0x9: "on" if b else "off", 0xB: "control"}.get(status >> 4)
            if kind:
                yield tick, kind, status & 15, a, b


def file_events(path: str, data: bytes, strict: bool = False) -> Iterator[tuple]:
    """Rows of EVENTS for a file. Of a broken track come the events before the break and a row of kind "broken" (with
    tick 0), of what is no MIDI file that row alone; the next track goes on. strict: raise Broken instead."""

    def broken(track: int, why: str) -> tuple:
        if strict:
            raise Broken(f"{path}: {why}")
        return path, max(ticks, 1), track, -1, 0, "broken", 0, 0, 0

    ticks = int.from_bytes(data[12:14], "big")
    if data[:4] != b"MThd" or len(data) < 14:
        yield broken(0, "no MIDI file")
        return
    at, track = 8 + int.from_bytes(data[4:8], "big"), 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        if data[at : at + 4] == b"MTrk":
            try:
                for seq, e in enumerate(track_events(data[at + 8 : at + 8 + size])):
                    yield path, ticks, track, seq, *e
                if at + 8 + size > len(data):
                    yield broken(track, "a track is cut off")
            except Broken as e:
                yield broken(track, str(e))
            track += 1
        at += 8 + size


def event_batches(events: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of EVENTS in batches of bounded size, whatever files they come from."""
    while rows := list(islice(events, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)


def events_of_files(files: DataFrame) -> DataFrame:
    """One row for each note, control or tempo event of MIDI files given as path and content, and one of kind "broken"
    for each break (see file_events). A task holds the events of a batch, not those of all files it was handed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from event_batches(e for b in batches for p, d in zip(b.column("path"), b.column("content")) for e in file_events(p.as_py(), d.as_py()))

    return files.select("path", "content").mapInArrow(run, EVENTS)


def read_midi_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of the MIDI files below a path."""
    return events_of_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.mid").option("recursiveFileLookup", "true").load(path))


def note_rows(events: DataFrame) -> DataFrame:
    """path, track, channel, midi, velocity, start_us, end_us: the k-th start of a pitch with its k-th end.

    Times follow the tempo changes of all tracks (120 beats a minute before the first). Starts without an end go.
    """
    w = Window.partitionBy("path").orderBy("tick")
    tempo = events.where("kind = 'tempo'").groupBy("path", "ticks_per_beat", "tick").agg(F.max_by("a", F.struct("track", "seq")).alias("us"))
    first = events.select("path", "ticks_per_beat").distinct().select("path", "ticks_per_beat", F.lit(-1).cast("long").alias("tick"), F.lit(500_000).alias("us"))
    changes = first.unionByName(tempo).withColumn("span", (F.lead("tick").over(w) - F.greatest("tick", F.lit(0))) * F.col("us") / F.col("ticks_per_beat"))
    changes = changes.withColumn("base", F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    marks = changes.select("path", "tick", F.struct(F.greatest("tick", F.lit(0)).alias("at"), "us", "base").alias("m"))

    e = events.where("kind in ('on', 'off')").unionByName(marks.withColumn("kind", F.lit("mark")), allowMissingColumns=True)
    m = F.last("m", ignorenulls=True).over(Window.partitionBy("path").orderBy("tick", F.when(F.col("kind") == "mark", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("m", m).where("kind <> 'mark'").withColumn("us", F.col("m.base") + (F.col("tick") - F.col("m.at")) * F.col("m.us") / F.col("ticks_per_beat"))
    pitch = ["path", "track", "channel", "a"]
    e = e.withColumn("k", F.row_number().over(Window.partitionBy(*pitch, "kind").orderBy("tick", "seq")))
    on = e.where("kind = 'on'").select(*pitch, "k", F.col("b").alias("velocity"), F.col("us").alias("start_us"))
    off = e.where("kind = 'off'").select(*pitch, "k", F.col("us").alias("end_us"))
    return on.join(off, [*pitch, "k"]).select("path", "track", "channel", F.col("a").alias("midi"), "velocity", F.round("start_us").cast("long").alias("start_us"), F.round("end_us").cast("long").alias("end_us"))


def _varlen(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def meta(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + _varlen(len(body)) + body


#: First bytes of the messages that are written, by kind.
STATUS = {"off": 0x80, "on": 0x90, "control": 0xB0}


class Track:
    """A track chunk that takes (tick, message) in order and keeps their bytes alone."""

    def __init__(self):
        self.body, self.last = bytearray(), 0

    def add(self, tick: int, message: bytes) -> None:
        self.body += _varlen(tick - self.last) + message
        self.last = tick

    def chunk(self) -> bytes:
        track = bytes(self.body) + b"\x00" + meta(0x2F, b"")
        return b"MTrk" + len(track).to_bytes(4, "big") + track


def track_bytes(events: Iterable[tuple[int, bytes]]) -> bytes:
    """A track chunk of (tick, message) in order."""
    track = Track()
    for tick, message in events:
        track.add(tick, message)
    return track.chunk()


def head_bytes(form: int, tracks: int, ticks_per_beat: int) -> bytes:
    return b"MThd" + b"".join(n.to_bytes(k, "big") for n, k in ((6, 4), (form, 2), (tracks, 2), (ticks_per_beat, 2)))


def tempo_meta(us_per_beat: int) -> bytes:
    return meta(0x51, us_per_beat.to_bytes(3, "big"))


def song_head(us_per_beat: int, beats: int, sharps: int, minor: bool) -> bytes:
    """The first track of a file of format 1: tempo, meter and key."""
    return track_bytes([(0, tempo_meta(us_per_beat)), (0, meta(0x58, bytes([beats, 2, 24, 8]))), (0, meta(0x59, bytes([sharps & 0xFF, int(minor)])))])


def named_track(name: str) -> Track:
    track = Track()
    track.add(0, meta(0x03, name.encode()))
    return track


def message(kind: str, channel: int, a: int, b: int) -> bytes:
    return bytes([STATUS[kind] | channel, a, b])


def tracks_bytes(tracks: list[tuple[str, list[tuple[int, str, int, int, int]]]], ticks_per_beat: int, us_per_beat: int, beats: int = 4, sharps: int = 0, minor: bool = False) -> bytes:
    """A file of format 1: a track of tempo, meter and key, then one for each (name, events), the events as (tick, kind,
    channel, a, b) in order."""
    chunks = [song_head(us_per_beat, beats, sharps, minor)]
    for name, events in tracks:
        track = named_track(name)
        for tick, *e in events:
            track.add(tick, message(*e))
        chunks.append(track.chunk())
    return head_bytes(1, len(chunks), ticks_per_beat) + b"".join(chunks)
