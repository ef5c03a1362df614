"""MusicXML scores by Spark's XML source, their notes in quarters, and their bars brought to a forced meter.

One voice a part is read: Spark gives a measure's elements by kind, so that backups and forwards have no place among
the notes. A part is one row while it is parsed; its measures and notes are rows after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "_id string, measure array<struct<attributes: struct<divisions: int>, note: array<struct<pitch: struct<step: string, alter: double, octave: int>, chord: string, rest: string, grace: string, duration: double>>>>"
STEPS = "C C D D E F F G G A A B".split()
SHARP = (1, 3, 6, 8, 10)


def read_musicxml(spark: SparkSession, path: str) -> DataFrame:
    """part, measure and seq (from 0), onset and length (quarters), midi (null for a rest) of the notes of scores.

    Divisions hold until a later measure changes them (1 before any). Notes of a chord begin with the note before them;
    grace notes, which have no length, go. A broken file's part gives what could be parsed of it.
    """
    parts = spark.read.format("xml").option("rowTag", "part").schema(PART).load(path)
    m = parts.select(F.col("_id").alias("part"), F.posexplode("measure").alias("measure", "m"))
    divisions = F.coalesce(F.last("m.attributes.divisions", ignorenulls=True).over(Window.partitionBy("part").orderBy("measure").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    n = m.select("part", "measure", divisions.alias("divisions"), F.posexplode("m.note").alias("seq", "n")).where("n.grace is null and n.duration is not null")
    p = F.col("n.pitch")
    base = F.create_map(*(F.lit(x) for s, v in (("C", 0), ("D", 2), ("E", 4), ("F", 5), ("G", 7), ("A", 9), ("B", 11)) for x in (s, v)))
    midi = F.when(F.col("n.rest").isNull() & p.isNotNull(), (p["octave"] + 1) * 12 + F.try_element_at(base, p["step"]) + F.coalesce(F.round(p["alter"]), F.lit(0.0)).cast("int"))
    n = n.select("part", "measure", "seq", F.col("n.chord").isNotNull().alias("chord"), (F.col("n.duration") / F.col("divisions")).alias("length"), midi.alias("midi"))
    before = Window.partitionBy("part", "measure").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(~F.col("chord"), F.col("length"))
    passed = F.coalesce(F.sum(own).over(before), F.lit(0.0))
    onset = passed - F.when(F.col("chord"), F.coalesce(F.last(own, ignorenulls=True).over(before), F.lit(0.0))).otherwise(0.0)
    return n.select("part", "measure", "seq", F.round(onset, 9).alias("onset"), "length", "midi")


def rebarred(notes: DataFrame, beats: int, beat_type: int, least: float = 0.125) -> DataFrame:
    """part, measure, seq, at, length, midi with every measure as long as the forced meter's bar.

    What begins past the barline goes, what reaches over it is cut there (least quarters stay), and where the last
    element of a measure is no rest, its notes last to the barline. at counts quarters from the start of the part.
    """
    bar = beats * 4 / beat_type
    kept = notes.where(F.col("onset") < bar)
    cut = F.greatest(F.least(F.col("onset") + F.col("length"), F.lit(bar)) - F.col("onset"), F.lit(least))
    last = F.max("onset").over(Window.partitionBy("part", "measure"))
    length = F.when((F.col("onset") == last) & F.col("midi").isNotNull(), F.greatest(F.lit(bar) - F.col("onset"), cut)).otherwise(cut)
    return kept.select("part", "measure", "seq", (F.col("measure") * bar + F.col("onset")).alias("at"), length.alias("length"), "midi")


def _element(e: Column) -> Column:
    """A note element of a struct with midi (null for a rest), chord and duration."""
    pc = F.pmod(e["midi"], F.lit(12)).cast("int")
    step = F.get(F.array(*map(F.lit, STEPS)), pc)
    alter = F.when(F.array_contains(F.array(*map(F.lit, SHARP)), pc), "<alter>1</alter>").otherwise("")
    pitch = F.concat(F.lit("<pitch><step>"), step, F.lit("</step>"), alter, F.lit("<octave>"), (F.floor(e["midi"] / 12) - 1).cast("string"), F.lit("</octave></pitch>"))
    return F.concat(F.lit("<note>"), F.when(e["chord"], "<chord/>").otherwise(""), F.coalesce(pitch, F.lit("<rest/>")), F.lit("<duration>"), e["duration"].cast("string"), F.lit("</duration></note>"))


def score_texts(elements: DataFrame, divisions: int) -> DataFrame:
    """part and the text of a score of that part alone: elements of part, measure, seq, midi (null for a rest), chord and
    duration (in divisions). A file holds one score, as XML has one root."""
    e = F.array_sort(F.collect_list(F.struct("seq", "midi", "chord", "duration")))
    m = elements.groupBy("part", "measure").agg(F.array_join(F.transform(e, _element), "").alias("notes"))
    head = F.when(F.col("measure") == 0, f"<attributes><divisions>{divisions}</divisions></attributes>").otherwise("")
    m = m.withColumn("xml", F.concat(F.lit('<measure number="'), (F.col("measure") + 1).cast("string"), F.lit('">'), head, F.col("notes"), F.lit("</measure>")))
    bars = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure", "xml"))), lambda x: x["xml"]), "")
    return m.groupBy("part").agg(bars.alias("bars")).select("part", F.concat(F.lit('<score-partwise version="3.1"><part id="'), F.col("part"), F.lit('">'), "bars", F.lit("</part></score-partwise>")).alias("value"))
