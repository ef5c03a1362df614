"""Ordered operators on rows of a key: islands, fills and sliding medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], label: Column, name: str = "island") -> DataFrame:
    """df with the number (from 1) of the run of equal labels that each row belongs to; nulls equal each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~label.eqNullSafe(F.lag(label).over(w))).cast("int"))
    return df.withColumn("_new", changed).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_islands(df: DataFrame, by: list[str], order: list[str], start: str, end: str, gap: int, name: str = "island") -> DataFrame:
    """Runs of rows whose start is at most gap after the end of the previous one."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((F.col(start) - F.lag(end).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def sliding_median(df: DataFrame, by: list[str], order: list[str], value: str, width: int, name: str) -> DataFrame:
    """Median of the width rows around each row (fewer at the edges; of an even number the mean of the middle two)."""
    half = width // 2
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)
    df = df.withColumn("_win", F.array_sort(F.collect_list(value).over(w)))
    n = F.size("_win")
    mid = F.element_at("_win", F.floor((n + 1) / 2).cast("int")) + F.element_at("_win", F.floor(n / 2).cast("int") + 1)
    return df.withColumn(name, mid / 2).drop("_win")
