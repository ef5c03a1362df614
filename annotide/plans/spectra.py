"""Queries of candidates checked against spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.operators.nnls import explained_notes
from annotide.plans.registry import query
from annotide.sources.notes import notes

SLICE = 5000
TRIADS = [(root, minor, sum(1 << (root + v) % 12 for v in ((0, 3, 7) if minor else (0, 4, 7)))) for root in range(12) for minor in (0, 1)]


def slice_notes(n: DataFrame) -> DataFrame:
    """song_id, f, low (the lowest note's pitch class), the weight of each note and of each pitch class (null without one)
    of slices of 5 s."""
    at = n.where("song_id is not null and start_ms is not null and midi is not null").groupBy("song_id", F.expr(f"start_ms div {SLICE}").alias("f"), "midi").agg(F.sum(F.col("amp") + 1).alias("v"))
    pc = F.pmod("midi", F.lit(12))
    of = [F.sum(F.when(pc == p, F.col("v"))).alias(f"v{p}") for p in range(12)]
    there = F.bit_or(F.call_function("shiftleft", F.lit(1), pc.cast("int"))).alias("there")
    return at.groupBy("song_id", "f").agg(F.pmod(F.min("midi"), F.lit(12)).alias("low"), there, F.collect_list(F.struct("midi", F.coalesce("v", F.lit(0)).alias("v"))).alias("notes"), *of)


def best_triads(k: int):
    """The k triads of most mass, of those of which a pitch class is there, as an array: mass, root, minor, mask."""
    def triad(root: int, minor: int, mask: int):
        tones = [F.col(f"v{p}") for p in range(12) if mask >> p & 1]
        total = sum((F.coalesce(t, F.lit(0)) for t in tones), F.lit(0))
        mass = F.when(F.coalesce(*tones).isNotNull(), total)
        return F.when(F.col("there").bitwiseAND(F.lit(mask)) != 0, F.struct(mass.isNull().alias("silent"), (-mass).alias("less"), F.lit(root).alias("root"), F.lit(minor).alias("minor"), F.lit(mask).alias("mask"), mass.alias("mass")))

    return F.slice(F.array_sort(F.array_compact(F.array(*(triad(*t) for t in TRIADS)))), 1, k)


@query()
def candidate_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three triads of each slice with the most mass, and how much of the slice's spectrum each leaves unexplained;
    the bass may always sound."""
    slices = slice_notes(notes(spark, sf_dir)).withColumn("best", best_triads(3))
    bass = F.call_function("shiftleft", F.lit(1), F.col("low").cast("int"))
    masks = F.transform("best", lambda c: c["mask"].bitwiseOR(bass).cast("int"))
    got = explained_notes(slices.select("song_id", "f", "best", masks.alias("masks"), F.col("notes.midi").alias("midis"), F.col("notes.v").cast("array<double>").alias("vs")), "midis", "vs", "masks")
    each = got.select("song_id", "f", F.posexplode(F.arrays_zip("best", "residuals")).alias("i", "x")).select("song_id", "f", (F.col("i") + 1).alias("rank"), "x.best.root", "x.best.minor", "x.best.mass", F.col("x.residuals").alias("residual"))
    again = Window.partitionBy("song_id", "f").orderBy("residual", "rank")
    return each.select("song_id", "f", "rank", "root", "minor", "mass", F.round("residual", 6).alias("residual"), F.row_number().over(again).alias("place"))
