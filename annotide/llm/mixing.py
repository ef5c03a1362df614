"""Mixing sources to target weights by Poisson replication.

A source with n rows, target weight w and an output of N rows has the repetition rate w * N / n. Every document
draws its count by inverting the Poisson distribution of that mean at a uniform number hashed from a seed and
its doc_id, is exploded by the count, and the copies are shuffled globally by a hash of seed, doc_id and copy.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotide.llm._common import Store, own_names, plain_names
from annotide.llm.quality_rules import let


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, alpha: float, weights: dict[str, float] | None, out_rows: int | None) -> DataFrame:
    """source, rate: the mean repetition of each source. weights: by source, missing ones 0; without it,
    the weight of a source is its row count to the power alpha. A null source is a source of its own."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(w)
    counts = counts.withColumn("w", w)
    total_w, total_n = counts.agg(F.sum("w"), F.sum("n")).first()
    rows = float(out_rows if out_rows is not None else total_n or 0)
    return counts.select("source", (F.lit(rows) * F.col("w") / F.lit(total_w or 1.0) / F.col("n")).alias("rate"))


def log_factorial(n: Column) -> Column:
    """Stirling's series; its error is below 1e-13 from n = 100 on."""
    return n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n * n * n)


def poisson_cdf(rate: Column) -> Column:
    """first and cdf: the array of F(first), F(first + 1), ... as far as the distribution has mass in double precision;
    terms are built from their logarithms, so large rates do not underflow, and start where they begin to count."""
    low = F.floor(rate - 12 * F.sqrt(rate) - 20)
    first = F.when(low >= 100, low).otherwise(0).cast("int")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")

    def step(s: Column, k: Column) -> Column:
        lp = s["lp"] + F.log(rate) - F.log(k.cast("double"))
        c = s["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(s["cdf"], F.array(c)).alias("cdf"))

    def whole(k: Column) -> Column:
        lp = F.when(k == 0, -rate).otherwise(k * F.log(rate) - rate - log_factorial(k.cast("double")))
        start = F.struct(lp.alias("lp"), F.exp(lp).alias("c"), F.array(F.exp(lp)).alias("cdf"))
        return F.struct(k.alias("first"), F.aggregate(F.sequence(k + 1, last), start, step, lambda s: s["cdf"]).alias("cdf"))

    return F.when(rate > 0, let(first, whole)).otherwise(F.struct(F.lit(0).alias("first"), F.array(F.lit(1.0)).alias("cdf")))


def poisson_mix(docs: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None, out_rows: int | None = None, seed: str = "mix") -> DataFrame:
    """docs with every row repeated by its Poisson count, in globally shuffled order.

    Added columns: copy_no (from 1), n_copies, rate, shuffle_key. Rows of one doc_id share their count (a null
    doc_id is hashed as the word null); texts are not looked at, so null or empty ones are mixed as any other.
    Empty tables give empty results. Columns of docs that clash with the added names are replaced.
    """
    added = ["copy_no", "n_copies", "rate", "shuffle_key"]
    docs = docs.drop(*added)
    store = Store(docs.sparkSession, "mix")
    # a row for each source, read back with its true size: planned as a broadcast only while it is small
    rates = store.put(source_rates(docs, alpha, weights, out_rows).select(F.col("source").alias("_source"), "rate", poisson_cdf(F.col("rate")).alias("_cdf")))
    docs, names = plain_names(docs)
    key = F.coalesce(F.col(names["doc_id"]).cast("string"), F.lit("null"))
    counted = (
        docs.join(rates, F.col(names["source"]).eqNullSafe(F.col("_source")))
        .withColumn("_u", hash_uniform(F.lit(seed), key))
        .withColumn("n_copies", F.col("_cdf.first") + F.size(F.filter("_cdf.cdf", lambda c: c <= F.col("_u"))))
        .drop("_source", "_cdf", "_u")
        .where("n_copies > 0")
    )
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy_no").cast("string"))))
    # a random partition and a random order within it: uniform over the corpus with a single exchange
    return keyed.select(*own_names(names), *added).repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
