"""Text sources: token corpora, keyed JSON, training logs and pasted chords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_chord_tokens(spark: SparkSession, path: str, column: str = "chords") -> DataFrame:
    """The other columns, pos and token of each token of a CSV column; section marks in <> go."""
    rows = spark.read.option("header", True).csv(path)
    kept = F.filter(F.split(F.trim(column), r"\s+"), lambda t: (t != "") & ~t.rlike("^<.*>$"))
    return rows.select(*(c for c in rows.columns if c != column), F.posexplode(kept).alias("pos", "token"))


def read_keyed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """id and fields of a JSON file that is one object keyed by id (gzip by its name). A file is one row's text."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(','))}>>")).alias("id", "v")).select("id", "v.*")


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """file, epoch, val_acc of the lines of training logs that report an epoch."""
    form = r"^EPOCH\s+(\d+)\b.*\bval_acc\s+([0-9.]+)"
    lines = spark.read.text(path).where(F.col("value").rlike(form))
    part = lambda g: F.regexp_extract("value", form, g)
    return lines.select(F.input_file_name().alias("file"), part(1).cast("int").alias("epoch"), part(2).cast("double").alias("val_acc"))


def pasted_chords(texts: DataFrame, beats_per_chord: int, times: int = 1, by: str = "song_id") -> DataFrame:
    """by, beat, chord: the words of a pasted text that are chords, one after the other, repeated."""
    form = r"^[A-Ga-g][#bs]?(m|maj|min|dim|aug|sus|add|M)?[0-9]*(/[A-G][#b]?)?$"
    chords = F.filter(F.split("text", r"[\s|,]+"), lambda w: w.rlike(form))
    rows = texts.select(by, F.size(chords).alias("n"), F.posexplode(chords).alias("pos", "chord")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.select(by, ((F.col("turn") * F.col("n") + F.col("pos")) * beats_per_chord).alias("beat"), "chord")
