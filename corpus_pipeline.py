"""A corpus pipeline: quality rules, line dedup, near-duplicates, mixing and encoding, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the folder of
spark.checkpoint.dir and reads it again as the next one's docs. An empty table stays empty; columns besides those of
documents, whatever their names, are carried by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.llm._common import Store, documents
from annotide.llm.byte_bpe import encode_documents
from annotide.llm.line_dedup import BLANKS, dedup_lines
from annotide.llm.mixing import poisson_mix
from annotide.llm.ngram_jaccard import drop_near_duplicates
from annotide.llm.quality_rules import judge


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, among them null, empty and short texts. A rate equal to its fence stays,
    repeated rows are judged alike, and null languages and sources are groups of their own."""
    return judge(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines, and from 20 characters on those near an earlier one, go, and with them documents of which no
    word is left; n_chars follows the text. Near are lines within an edit for every 20 characters, 8 at most. The line
    that comes first by doc_id (null first), hash of the text and place stays; rows of equal doc_id and text keep the
    same lines, and null and empty texts stay as they are."""
    got = dedup_lines(docs, threshold=8, min_chars=1, edit_chars=20, percent=5)
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.col("text"), F.lit(BLANKS)) == "")
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return got.where(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of least doc_id, and one of rows that are repeated. Texts
    without words, and null ones, are copies of nothing and stay."""
    return drop_near_duplicates(docs, width=5, threshold=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its Poisson count says, in shuffled order. Rows of one doc_id get one count, a null
    source is a source, and texts are not looked at."""
    return poisson_mix(docs, alpha=0.5).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text beside the other columns of documents; null and empty texts have none. Columns that
    documents does not have are left out."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = encode_documents(docs, ranks, public_tokenizers.PATTERN, carry=("doc_id", "lang", "source", "n_chars"))
    return got.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: Line dedup, the Jaccard join and the encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, store.put(stage(spark, docs, sf_dir))
        if i:
            store.drop(before)
    return docs
