"""Files that a song's tables become: project JSON, Markdown reports, frame labels, MIDI."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.operators.stateful import fold_sorted
from annotide.sources.midi import Track, head_bytes, message, named_track, song_head, tempo_meta


def ordered(fields: list[Column], order: str) -> Column:
    """The rows of a group as an array of structs in the order of a field that goes first."""
    return F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields)))


def song_projects(segments: DataFrame, bpm: float, by: str = "song_id", unsure: float = 0.45) -> DataFrame:
    """by, project: one JSON text for each song. Silence (N) and rows before -50 ms go, times are clamped at 0, and
    chords of low confidence get a question mark. segments: by, start_ms, label, conf."""
    s = segments.where((F.col("label") != "N") & (F.col("start_ms") >= -50))
    chord = F.concat("label", F.when(F.col("conf") < unsure, "?").otherwise(""))
    rows = ordered([(F.greatest(F.col("start_ms"), F.lit(0)) / 1000).alias("time"), chord.alias("chord")], "start_ms")
    timeline = F.transform(rows, lambda r: F.struct(r["time"].alias("time"), r["chord"].alias("chord")))
    project = F.to_json(F.struct(F.lit(5).alias("version"), F.lit(str(bpm)).alias("bpm"), timeline.alias("timeline")))
    return s.groupBy(by).agg(project.alias("project"))


def low_confidence(segments: DataFrame, below: float, k: int, by: str = "song_id") -> DataFrame:
    """The first k segments of each song below a confidence, the least sure first."""
    w = Window.partitionBy(by).orderBy("conf", "start_ms")
    return segments.where(F.col("conf") < below).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reports(segments: DataFrame, by: str = "song_id", unsure: float = 0.45) -> DataFrame:
    """by, report: a Markdown text for each song, with its unsure segments, the worst first, and a table of all."""
    clock = F.format_string("%02d:%02d", F.expr("start_ms div 60000"), F.expr("start_ms div 1000 % 60"))
    line = F.format_string("| %s | %s | %.2f |", clock, F.col("label"), F.col("conf").cast("double"))
    s = segments.withColumn("_line", line).withColumn("_worst", F.when(F.col("conf") < unsure, F.struct("conf", "start_ms", "_line")))
    lines = F.array_join(F.transform(ordered([F.col("_line").alias("x")], "start_ms"), lambda r: r["x"]), "\n")
    worst = F.array_join(F.transform(F.array_sort(F.collect_list("_worst")), lambda r: r["_line"]), "\n")
    head = "| time | chord | confidence |\n|-|-|-|\n"
    return s.groupBy(by).agg(F.concat(F.lit("## Unsure\n\n" + head), worst, F.lit("\n\n## All\n\n" + head), lines, F.lit("\n")).alias("report"))


def midi_files(notes: DataFrame, by: str = "song_id", ticks_per_beat: int = 480, us_per_beat: int = 500_000) -> DataFrame:
    """by, content: a standard MIDI file (format 0) for each song of notes start_ms, end_ms, midi, velocity. Events are
    made and ordered by Spark; a song's are packed one after the other as they come."""
    tick = lambda c: F.round(F.col(c) * 1000 * ticks_per_beat / us_per_beat).cast("long")
    on = F.struct(tick("start_ms").alias("tick"), F.lit(1).alias("kind"), "midi", "velocity")
    off = F.struct(F.greatest(tick("end_ms"), tick("start_ms") + 1).alias("tick"), F.lit(0).alias("kind"), "midi", F.lit(0).cast("int").alias("velocity"))
    events = notes.select(by, F.col("midi").cast("int").alias("midi"), F.col("velocity").cast("int").alias("velocity"), "start_ms", "end_ms").select(by, F.explode(F.array(on, off)).alias("e")).select(by, "e.*")

    class File:
        def __init__(self):
            self.track = Track()
            self.track.add(0, tempo_meta(us_per_beat))

        def push(self, g: pd.DataFrame) -> None:
            self.key = g[by].iloc[0]
            for tick, on, p, v in zip(g["tick"].tolist(), g["kind"].tolist(), g["midi"].tolist(), g["velocity"].tolist()):
                self.track.add(tick, message("on" if on else "off", 0, p, v))

        def end(self) -> pd.DataFrame:
            return pd.DataFrame({by: [self.key], "content": [head_bytes(0, 1, ticks_per_beat) + self.track.chunk()]})

    return fold_sorted(events, by, ["tick", "kind", "midi", "velocity"], File, f"{by} {events.schema[by].dataType.simpleString()}, content binary")


def chord_notes(segments: DataFrame, voicing: Column, by: str = "song_id") -> DataFrame:
    """by, start_ms, end_ms, midi, velocity: the notes of block chords, those of one chord at once; the surer a chord is, the
    louder. Silence (N) goes. segments: by, start_ms, end_ms, label, conf; voicing: an array of pitches."""
    velocity = F.greatest(F.least((40 + 70 * F.coalesce("conf", F.lit(0.5))).cast("int"), F.lit(127)), F.lit(1))
    return segments.where(F.col("label") != "N").select(by, "start_ms", "end_ms", F.explode(F.array_sort(F.array_distinct(voicing))).alias("midi"), velocity.alias("velocity"))


def note_events(notes: DataFrame, track: Column, ticks_per_beat: int = 480, us_per_beat: int = 500_000, by: str = "song_id", channel: int = 0) -> DataFrame:
    """by, track, tick, kind, channel, a, b of the starts and ends of notes; an end is a sixteenth after its start at least
    where it isn't behind it."""
    tick = lambda c: F.greatest(F.round(F.col(c) * 1000 * ticks_per_beat / us_per_beat), F.lit(0)).cast("long")
    n = notes.select(by, track.alias("track"), tick("start_ms").alias("s"), tick("end_ms").alias("e"), F.col("midi").cast("int").alias("a"), F.col("velocity").cast("int").alias("b"))
    n = n.withColumn("e", F.when(F.col("e") <= F.col("s"), F.col("s") + ticks_per_beat // 4).otherwise(F.col("e")))
    on = F.struct(F.col("s").alias("tick"), F.lit("on").alias("kind"), F.lit(channel).alias("channel"), "a", "b")
    off = F.struct(F.col("e").alias("tick"), F.lit("off").alias("kind"), F.lit(channel).alias("channel"), "a", F.lit(0).alias("b"))
    return n.select(by, "track", F.explode(F.array(on, off)).alias("x")).select(by, "track", "x.*")


def sustain_events(controls: DataFrame, track: Column, ticks_per_beat: int = 480, us_per_beat: int = 500_000, by: str = "song_id", channel: int = 0) -> DataFrame:
    """by, track, tick, kind, channel, a, b of sustain pedal values (controller 64). controls: by, t (ms), value."""
    tick = F.greatest(F.round(F.col("t") * 1000 * ticks_per_beat / us_per_beat), F.lit(0)).cast("long")
    return controls.select(by, track.alias("track"), tick.alias("tick"), F.lit("control").alias("kind"), F.lit(channel).alias("channel"), F.lit(64).alias("a"), F.col("value").cast("int").alias("b"))


def song_files(events: DataFrame, by: str = "song_id", ticks_per_beat: int = 480, us_per_beat: int = 500_000, sharps: int = 0, minor: bool = False) -> DataFrame:
    """by, content: a MIDI file of format 1 for each song, with a track for each name. events: by, track, tick, kind (on,
    off, control), channel, a, b. At one tick ends come first, then controls, then starts."""
    order = F.when(F.col("kind") == "off", 0).when(F.col("kind") == "control", 1).otherwise(2)

    class File:
        def __init__(self):
            self.chunks, self.name, self.track = [song_head(us_per_beat, 4, sharps, minor)], None, None

        def push(self, g: pd.DataFrame) -> None:
            self.key = g[by].iloc[0]
            for name, tick, *e in zip(*(g[c].tolist() for c in ("track", "tick", "kind", "channel", "a", "b"))):
                if self.track is None or name != self.name:
                    self.close()
                    self.name, self.track = name, named_track(name)
                self.track.add(tick, message(*e))

        def close(self) -> None:
            if self.track is not None:
                self.chunks.append(self.track.chunk())

        def end(self) -> pd.DataFrame:
            self.close()
            return pd.DataFrame({by: [self.key], "content": [head_bytes(1, len(self.chunks), ticks_per_beat) + b"".join(self.chunks)]})

    rows = events.select(by, "track", "tick", order.alias("o"), "a", "b", "kind", "channel")
    return fold_sorted(rows, by, ["track", "tick", "o", "a", "b", "kind", "channel"], File, f"{by} {events.schema[by].dataType.simpleString()}, content binary")
