"""Chord templates against sets of pitch classes, as an equi-join on a 12-bit mask."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.dims import INTERVAL_WEIGHTS, TEMPLATES


@lru_cache(maxsize=8)
def candidate_rows(missing_penalty: float = 1.5) -> list[tuple[int, int, int, str, float]]:
    """mask, root, tmpl, sfx, score for each of the 4,096 masks and each chord that fits it: at least three quarters of
    the template's tones are there; present tones add their interval's weight, missing ones and others cost."""
    out = []
    for mask in range(1, 4096):
        size = mask.bit_count()
        for root in range(12):
            turned = ((mask >> root) | (mask << (12 - root))) & 4095
            for tmpl, (sfx, ivs) in enumerate(TEMPLATES):
                here = [v for v in ivs if turned >> v & 1]
                if 4 * len(here) >= 3 * len(ivs):
                    out.append((mask, root, tmpl, sfx, sum(INTERVAL_WEIGHTS[v] for v in here) - missing_penalty * (len(ivs) - len(here)) - (size - len(here))))
    return out


def mask_candidates(spark: SparkSession, k: int, missing_penalty: float = 1.5) -> DataFrame:
    """mask, rank, root, tmpl, sfx, score: the best k chords of every mask, best first, ties by root and template.
    Its size depends on the templates alone (4,096 masks), so it can always be broadcast."""
    rows: list[tuple] = []
    last, rank = 0, 0
    for r in sorted(candidate_rows(missing_penalty), key=lambda r: (r[0], -r[4], r[1], r[2])):
        rank = rank + 1 if r[0] == last else 1
        last = r[0]
        if rank <= k:
            rows.append((r[0], rank, *r[1:]))
    return F.broadcast(spark.createDataFrame(rows, "mask long, rank int, root int, tmpl int, sfx string, score double"))


def best_chords(masks: DataFrame, k: int = 1, missing_penalty: float = 1.5, how: str = "left") -> DataFrame:
    """masks (with a column mask) and the best k chords of each."""
    dim = mask_candidates(masks.sparkSession, k, missing_penalty)
    return masks.withColumn("mask", F.col("mask").cast("long")).join(dim, "mask", how)


def rival_gap(candidates: DataFrame, by: list[str]) -> DataFrame:
    """by, the best candidate and its lead over the best of another root (4.0 without one)."""
    w = Window.partitionBy(*by)
    top = F.first("root").over(w.orderBy("rank"))
    c = candidates.withColumn("top_root", top)
    return c.groupBy(*by).agg(F.min_by("root", "rank").alias("root"), F.min_by("sfx", "rank").alias("sfx"), F.max("score").alias("best"), F.coalesce(F.max("score") - F.max(F.when(F.col("root") != F.col("top_root"), F.col("score"))), F.lit(4.0)).alias("gap"))
