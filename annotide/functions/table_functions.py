"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, IntegralType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from annotide.operators.harmony import candidate_rows


@lru_cache(maxsize=1)
def ranked_candidates() -> dict[int, list[tuple[int, str, float]]]:
    out: dict[int, list[tuple[int, str, float]]] = {}
    for mask, root, _, sfx, score in sorted(candidate_rows(), key=lambda r: (r[0], -r[4], r[1], r[2])):
        out.setdefault(mask, []).append((root, sfx, score))
    return out


class ChordCandidates:
    """chord_candidates(mask, k): rank, root, sfx, score of the best k chords (8 unless given) of a 12-bit mask; none of a null
    or empty one. k has to be a constant of one or more."""

    @staticmethod
    def analyze(mask: AnalyzeArgument, k: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(mask.dataType, (IntegralType, NullType)):
            raise ValueError(f"mask has to be an integer, not {mask.dataType.simpleString()}")
        if k is not None and (not k.isConstantExpression or not isinstance(k.value, int) or k.value < 1):
            raise ValueError("k has to be a constant of one or more")
        return AnalyzeResult(StructType().add("rank", IntegerType()).add("root", IntegerType()).add("sfx", StringType()).add("score", DoubleType()))

    def eval(self, mask: int | None, k: int = 8) -> Iterator[tuple]:
        for i, c in enumerate(ranked_candidates().get(0 if mask is None else mask & 4095, [])[:k], 1):
            yield i, *c


def register(spark: SparkSession) -> None:
    spark.udtf.register("chord_candidates", udtf(ChordCandidates))
