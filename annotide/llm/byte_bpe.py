"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of at most chunk_chars characters is encoded where it is read. A longer one is cut into chunks that overlap;
the chunks are pre-tokenised in parallel, neighbours are stitched at a pre-token boundary of their overlap on
which both agree, and the pieces between such cuts are encoded in parallel. Where an overlap holds no common
boundary, the two chunks simply become one piece, so the ids are those of the whole text in every case.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotide.llm._common import Store, hash128, text_or_empty

#: Characters that a match may look at beyond its end; boundaries nearer to a chunk's end are not trusted.
LOOKAHEAD = 16


@lru_cache(maxsize=2)
def load_encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> list[bytes]:
    """The bytes of every id; ids that the ranks leave free have none."""
    with open(ranks_path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def encode_text(enc, text: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit numbers."""
    return np.asarray(enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), dtype="<u4").tobytes()


def _encode_batches(ranks_path: str, pattern: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [encode_text(enc, t) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(ids, pa.binary())], [*keys, "ids"])

    return run


def boundaries(pattern: str, chunk: str, at: int, lo: int, hi: int) -> list[int]:
    """Ends of pre-tokens in the chunk, as positions of the whole text within [lo, hi). Kept are those after a
    character that is not white space: what stands before such a cut never depends on what follows it."""
    import regex

    return [p for m in regex.finditer(pattern, chunk) if lo <= (p := at + m.end()) < hi and not m.group()[-1].isspace()]


def _zones(pattern: str, chunk_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for i, t in zip(b.column("i").to_pylist(), b.column("chunk").to_pylist()):
                at = i * chunk_chars
                own = boundaries(pattern, t, at, at, at + len(t) - LOOKAHEAD)
                right.append([p for p in own if at < p < at + overlap] if i else [])
                left.append([p for p in own if p > at + chunk_chars])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("i"), pa.array(left, kind), pa.array(right, kind)], ["k1", "k2", "i", "left", "right"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [b"".join(x["ids"] for x in parts) for parts in b.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(ids, pa.binary())], ["k1", "k2", "ids"])


def _cut(places: Callable[[str, list[int] | None], list[tuple[int, int]]], most: int = 1 << 22):
    """The parts of each text from the places (begin, end) that are given for it, with their number; a text is read once."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["k1", "k2", "i", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for r in range(b.num_rows):
                k1, k2, t = (b.column(c)[r].as_py() for c in ("k1", "k2", "text"))
                for i, (lo, hi) in enumerate(places(t, b.column("cuts")[r].as_py() if "cuts" in b.schema.names else None)):
                    out.append((k1, k2, i, t[lo:hi]))
                    size += min(hi, len(t)) - lo
                    if size >= most:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)

    return run


def encode_long(texts: DataFrame, ranks_path: str, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """k1, k2, ids of a table k1, k2, text of different texts, each encoded in parallel pieces."""
    chunks = texts.select("k1", "k2", "text").mapInArrow(_cut(lambda t, _: [(a, a + chunk_chars + overlap) for a in range(0, len(t), chunk_chars)]), "k1 long, k2 long, i int, text string").withColumnRenamed("text", "chunk")
    zones = chunks.repartition("k1", "i").mapInArrow(_zones(pattern, chunk_chars, overlap), "k1 long, k2 long, i int, left array<int>, right array<int>")
    following = Window.partitionBy("k1", "k2").orderBy("i")
    cuts = zones.select("k1", "k2", F.array_min(F.array_intersect("left", F.lead("right").over(following))).alias("cut")).where("cut is not null").groupBy("k1", "k2").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    whole = texts.join(cuts, ["k1", "k2"], "left").withColumn("cuts", F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.char_length("text"))))
    pieces = whole.select("k1", "k2", "text", "cuts").mapInArrow(_cut(lambda t, cuts: list(zip(cuts[:-1], cuts[1:]))), "k1 long, k2 long, i int, text string")
    ids = pieces.repartition("k1", "i").mapInArrow(_encode_batches(ranks_path, pattern, ["k1", "k2", "i"]), "k1 long, k2 long, i int, ids binary")
    parts = ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    return parts.mapInArrow(_joined, "k1 long, k2 long, ids binary")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",), chunk_chars: int = 1 << 15, overlap: int = 512) -> DataFrame:
    """The carried columns and ids (little-endian unsigned 32-bit numbers) of every row of docs.

    Each match of pattern is encoded by the ranks by itself; no special tokens. Null texts are empty ones and give
    no ids. Texts above chunk_chars are encoded once for all their copies; repeated rows come out each. Columns that
    are not carried are ignored, whatever their names; carried ones must not be named ids. An empty table gives an
    empty result. A piece's ids are held by one task, and so are those of a whole text at the end, as its row is.
    """
    store = Store(docs.sparkSession, "bpe")
    kept = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(carry, kept)), text_or_empty().alias("text"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    is_long = F.char_length("text") > chunk_chars
    short = rows.where(~is_long).mapInArrow(_encode_batches(ranks_path, pattern, kept), f"{kinds}, ids binary")
    k1, k2 = hash128(F.col("text"))
    long_rows = store.put(rows.where(is_long).select(*kept, k1.alias("k1"), k2.alias("k2"), "text"))
    texts = long_rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    long_ids = store.put(encode_long(texts, ranks_path, pattern, chunk_chars, overlap))
    long = long_rows.select(*kept, "k1", "k2").join(long_ids, ["k1", "k2"]).select(*kept, "ids")
    return short.unionByName(long).select(*(F.col(k).alias(c) for c, k in zip(carry, kept)), "ids")


def decode_ids(rows: DataFrame, ranks_path: str) -> DataFrame:
    """rows (doc_id, ids) with decoded: the bytes of all ids one after the other. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = token_bytes(ranks_path)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out = [b"".join(map(by_id.__getitem__, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
