"""Temporal joins that plan as hash joins: every range condition comes with an equality on a time bucket.

Times are integers. Intervals are [start, end); those of no length match nothing. Keys in `by` are compared with
plain equality, so rows with a null key match nothing. Joins of exploded rows ask for a merge: Spark's size of a side
doesn't count what an explode adds, so it would broadcast sides of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(c: Column | str, n: int) -> Column:
    """Floored integer division."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(n)).cast("long")


def grid(songs: DataFrame, by: str, end: str, step: int) -> DataFrame:
    """by, t: the points 0, step, 2 * step, ... up to end of each row."""
    return songs.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col(end), F.lit(step).cast("long"))).alias("t"))


def interval_join(probes: DataFrame, intervals: DataFrame, by: list[str], bucket: int, t: str = "t", start: str = "start_ms", end: str = "end_ms", how: str = "inner") -> DataFrame:
    """Every interval that holds the point t of a probe; how is inner or left."""
    p = probes.withColumn("_b", _div(t, bucket))
    i = intervals.where(F.col(end) > F.col(start)).withColumn("_ib", F.explode(F.sequence(_div(start, bucket), _div(F.col(end) - 1, bucket))))
    for k in by:
        i = i.withColumnRenamed(k, f"_i_{k}")
    on = (F.col("_b") == F.col("_ib")) & (F.col(start) <= F.col(t)) & (F.col(t) < F.col(end))
    for k in by:
        on = on & (F.col(k) == F.col(f"_i_{k}"))
    return p.join(i.hint("merge"), on, how).drop("_b", "_ib", *(f"_i_{k}" for k in by))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], bucket: int, min_overlap: int = 0) -> DataFrame:
    """Pairs of intervals (l_start, l_end) and (r_start, r_end) that share more than min_overlap, with overlap. A pair
    that shares several buckets comes out once, in the bucket where the shared part starts."""
    a = left.withColumn("_b", F.explode(F.sequence(_div("l_start", bucket), _div(F.greatest(F.col("l_end") - 1, F.col("l_start")), bucket))))
    b = right.withColumn("_b", F.explode(F.sequence(_div("r_start", bucket), _div(F.greatest(F.col("r_end") - 1, F.col("r_start")), bucket))))
    begin = F.greatest("l_start", "r_start")
    out = a.join(b.hint("merge"), [*by, "_b"]).where(_div(begin, bucket) == F.col("_b")).withColumn("overlap", F.least("l_end", "r_end") - begin)
    return out.where(F.col("overlap") > min_overlap).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], t: str, payload: list[str], bucket: int | None = None) -> DataFrame:
    """left with the payload of the last right row at or before t (null without one); right has one row for each
    key and t. Both sides are in a single ordered window over each key, in one exchange, or, with a bucket, over each
    bucket of a key's time: then the last right row of every bucket goes on to the later ones as a row of its own, and
    no task sorts more than a bucket. Left rows of null time get null."""
    kind = F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType)
    a = left.withColumns({"_r": kind, "_side": F.lit(1)})
    b = right.select(*by, t, F.struct(*payload).alias("_r"), F.lit(0).alias("_side"))
    own = list(by)
    if bucket:
        own = [*by, "_b"]
        a, b = (x.withColumn("_b", _div(t, bucket)) for x in (a, b))
        ends = b.groupBy(*own).agg(F.max_by("_r", t).alias("_r")).withColumn("_side", F.lit(1))
        marks = a.select(*own).distinct().select(*own, kind.alias("_r"), F.lit(0).alias("_side")).unionByName(ends)
        before = Window.partitionBy(*by).orderBy("_b", "_side").rowsBetween(Window.unboundedPreceding, -1)
        carried = marks.withColumn("_r", F.last("_r", ignorenulls=True).over(before)).where("_side = 0 and _r is not null").select(*own, F.lit(None).cast(right.schema[t].dataType).alias(t), "_r", "_side")
        b = b.unionByName(carried)
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*own).orderBy(F.col(t).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(t).isNotNull(), F.last(F.when(F.col("_side") == 0, F.col("_r")), ignorenulls=True).over(w))
    return both.withColumn("_at", at).where("_side = 1").select(*left.columns, *(F.col(f"_at.{c}").alias(c) for c in payload))


def lerp_join(left: DataFrame, knots: DataFrame, by: list[str], t: str, x: str, y: str, name: str) -> DataFrame:
    """left with the value at t of the line through its key's knots (x, y): straight between neighbours, and on along the
    first or last piece outside. knots may come several to an x; on a piece of no width, and with one knot alone, the
    value is that of the piece's first knot, and without knots null. One exchange, as for asof_join."""
    w = Window.partitionBy(*by).orderBy(x, y)
    first = F.row_number().over(w) == 1
    here, there, before = F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.struct(F.lead(x).over(w).alias("x"), F.lead(y).over(w).alias("y")), F.struct(F.lag(x).over(w).alias("x"), F.lag(y).over(w).alias("y"))
    ends = F.lead(y).over(w).isNull()
    k = knots.select(*by, x, y, F.when(~ends | first, here).otherwise(before).alias("_a"), F.when(ends, here).otherwise(there).alias("_z"), F.row_number().over(w).alias("_k"))
    # a knot answers for all up to the next one, the first also for all before it; of several at an x the last
    k = k.withColumn("_s", F.when(F.col("_k") == 1, F.lit(None)).otherwise(F.col(x)))
    k = k.groupBy(*by, "_s").agg(F.max_by(F.struct("_a", "_z"), "_k").alias("_p")).select(*by, F.col("_s").alias(t), "_p.*")
    a = left.withColumns({"_a": F.lit(None).cast(k.schema["_a"].dataType), "_z": F.lit(None).cast(k.schema["_z"].dataType), "_side": F.lit(1)})
    both = a.unionByName(k.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    piece = F.last(F.when(F.col("_side") == 0, F.struct("_a", "_z")), ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col(t).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0))
    p = both.withColumn("_p", piece).where("_side = 1")
    width = F.col("_p._z.x") - F.col("_p._a.x")
    value = F.col("_p._a.y") + F.when(width == 0, F.lit(0.0)).otherwise((F.col(t) - F.col("_p._a.x")) * (F.col("_p._z.y") - F.col("_p._a.y")) / width)
    return p.select(*left.columns, F.when(F.col(t).isNotNull(), value).alias(name))


def near_join(left: DataFrame, right: DataFrame, by: list[str], tolerance: int, lt: str, rt: str, how: str = "inner") -> DataFrame:
    """Pairs of points with |lt - rt| <= tolerance; how is inner, left, left_semi or left_anti."""
    a = left.withColumn("_b", _div(lt, tolerance + 1))
    b = right.withColumn("_rb", F.explode(F.array(*(_div(rt, tolerance + 1) + F.lit(d) for d in (-1, 0, 1)))))
    for k in by:
        b = b.withColumnRenamed(k, f"_i_{k}")
    on = (F.col("_b") == F.col("_rb")) & (F.abs(F.col(lt) - F.col(rt)) <= tolerance)
    for k in by:
        on = on & (F.col(k) == F.col(f"_i_{k}"))
    out = a.join(b.hint("merge"), on, how)
    return out.drop("_b", "_rb", *(f"_i_{k}" for k in by))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order; rows are cut before the exchange where Spark can."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
