"""Helpers shared by the training-data operators: reading, shared-folder tables, hash keys, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether shuffle files go when the write that made them ends, and not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary folder only for local[...] sessions that name none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return own_dir()


@lru_cache(maxsize=1)
def own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="annotide-")


class Store:
    """Tables in the shared folder that cut lineage: each is written once and read back with exact sizes,
    so that joins against small ones are planned as broadcasts and lost executors replay little."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{store_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(SHUFFLES_GO)
        self.spark.conf.set(SHUFFLES_GO, "true")  # a table is written once, and then nothing reads its shuffles again
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns numbered, so that none clashes with what an operator adds, and the number of each name."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def own_names(names: dict[str, str]) -> list[Column]:
    return [F.col(n).alias(c) for c, n in names.items()]


def hash128(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a value: equal values are the only ones that agree in both, in practice."""
    return F.xxhash64(c), F.xxhash64(F.lit("second"), c)


def keep_possible(store: Store, rows: DataFrame, keys: DataFrame, key: str, n_words: int = 1 << 18) -> DataFrame:
    """rows whose key may be among the keys; none that is goes, and most others do while the keys are fewer than the bits.

    The keys are hashed to single bits of at most n_words 64-bit words. This table, and so the broadcast, is bounded
    by n_words at any corpus size; with more keys than bits it only lets more rows pass to the exact join that follows.
    """
    h = F.xxhash64(key)
    word, bit = h.bitwiseAND(F.lit(n_words - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")
    bits = store.put(keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))
    hit = (F.col("_at") == F.col("_word")) & (F.expr("shiftright(_bits, _of) & 1L") == 1)
    return rows.withColumns({"_at": word, "_of": bit}).join(F.broadcast(bits), hit, "left_semi").drop("_at", "_of")


def connected_components(store: Store, edges: DataFrame) -> DataFrame:
    """Class of every node of an undirected graph.

    edges: columns a, b of one orderable type. Returns node, root (the least node of its component).
    Alternates large-star and small-star steps on a table in the shared folder until the edge set stands
    still; every step is a partial aggregate and a join on the node, so hub nodes are split by AQE.
    An empty graph gives an empty table.
    """
    cur = store.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sums = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: greater neighbours of u move to u's least neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = store.put(small)
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(cur)
        cur = new
        if tuple(got) == sums:
            break
        sums = tuple(got)
    node = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return node.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
