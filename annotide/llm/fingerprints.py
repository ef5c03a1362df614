"""Document fingerprints as invertible Bloom lookup sketches.

The paragraphs of a text (its lines, cut into passages at sentence ends and after PASSAGE words) are hashed; a
passage that occurs again is hashed with its number, so texts are multisets. Every digest goes into three cells of
a small table, as a count and an exclusive or of digests and of check sums. Two tables subtract; peeling cells that
hold one digest recovers the digests in which the texts differ, and a table of twice the size is tried for pairs
that do not peel completely. All pairs of a batch are subtracted and peeled in step by numpy.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.llm._common import text_or_empty

PASSAGE = 8
_PASSAGES = re.compile(r"(?:\S*[^\s.!?][^\S\n]+){0,%d}\S+" % (PASSAGE - 1))
CELLS = 24  # of the published fingerprint: three parts of eight
HASHES = 3

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and digest of every passage; equal passages of a text are told apart by their number."""
    found = [[xxhash.xxh3_64_intdigest(p) for p in _PASSAGES.findall(t)] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    raw = np.array([d for f in found for d in f], np.uint64)
    order = np.lexsort((raw, owner))
    owner, raw = owner[order], raw[order]
    new = np.ones(len(raw), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (raw[1:] != raw[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(raw)), 0)) if len(raw) else np.zeros(0, np.int64)
    again = np.arange(len(raw)) - first
    return owner, mix(raw ^ mix(again.astype(np.uint64), 7))


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The HASHES cells of each digest, one in each part of the table."""
    part = cells // HASHES
    return np.stack([mix(keys, 11 + i) % np.uint64(part) + np.uint64(i * part) for i in range(HASHES)], 1).astype(np.int64)


class Sketches:
    """Tables of n texts: counts, xor of digests and xor of check sums, each [n, cells]."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count = np.zeros((n, cells), np.int32)
        self.key = np.zeros((n, cells), np.uint64)
        self.check = np.zeros((n, cells), np.uint64)

    def insert(self, owner: np.ndarray, keys: np.ndarray, sign: int | np.ndarray = 1) -> None:
        at = (owner[:, None] * self.cells + places(keys, self.cells)).ravel()
        np.add.at(self.count.ravel(), at, np.repeat(np.broadcast_to(sign, keys.shape), HASHES).astype(np.int32))
        np.bitwise_xor.at(self.key.ravel(), at, np.repeat(keys, HASHES))
        np.bitwise_xor.at(self.check.ravel(), at, np.repeat(mix(keys, 5), HASHES))

    def minus(self, other: "Sketches") -> "Sketches":
        out = Sketches(0, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def rows(self, which: np.ndarray) -> "Sketches":
        out = Sketches(0, self.cells)
        out.count, out.key, out.check = self.count[which], self.key[which], self.check[which]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner and digest of all that could be recovered, and whether each table came out empty."""
        owners, keys = [], []
        while True:
            pure = (np.abs(self.count) == 1) & (self.check == mix(self.key.ravel(), 5).reshape(self.key.shape))
            o, c = np.nonzero(pure)
            if not len(o):
                break
            k, s = self.key[o, c], self.count[o, c]
            once = np.unique(np.stack([o.astype(np.uint64), k], 1), axis=0, return_index=True)[1]
            o, k, s = o[once], k[once], s[once]
            self.insert(o, k, -s)
            owners.append(o)
            keys.append(k)
        empty = ~((self.count != 0) | (self.key != 0) | (self.check != 0)).any(1)
        return np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(keys) if keys else np.zeros(0, np.uint64), empty

    def strings(self) -> list[str]:
        """One string for each table: its counts, digests and 32 bits of check sums in base64."""
        flat = np.concatenate([self.count.astype("<i4").view(np.uint8), self.key.astype("<u8").view(np.uint8), (self.check >> np.uint64(32)).astype("<u4").view(np.uint8)], 1)
        return [base64.b64encode(r.tobytes()).decode() for r in flat]


def build(n: int, owner: np.ndarray, keys: np.ndarray, cells: int) -> Sketches:
    out = Sketches(n, cells)
    out.insert(owner, keys)
    return out


def _pick(owner: np.ndarray, keys: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The passages of some texts, renumbered by their place in which."""
    number = np.full(n, -1)
    number[which] = np.arange(len(which))
    keep = number[owner] >= 0
    return number[owner[keep]], keys[keep]


def differences(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], base: tuple[Sketches, Sketches]) -> np.ndarray:
    """Number of digests in which texts a[i] and b[i] differ: peeled from the base tables, and from tables of
    twice the cells for as long as some do not peel."""
    out = np.zeros(n, np.int64)
    todo, cells = np.arange(n), base[0].cells
    diff = base[0].minus(base[1])
    while len(todo):
        owner, _, done = diff.peel()
        found = np.bincount(owner, minlength=len(todo))
        out[todo[done]] = found[done]
        todo = todo[~done]
        cells *= 2
        diff = build(len(todo), *_pick(*a, todo, n), cells).minus(build(len(todo), *_pick(*b, todo, n), cells)) if len(todo) else diff
    return out


def likeness(size_a: np.ndarray, size_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Shared passages over all passages of both; 1 for two texts without any."""
    both = size_a + size_b
    return np.where(both == 0, 1.0, (both - differ) / np.maximum(both + differ, 1))


def compare_batch(texts: list[str], edited: list[str], following: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    n = len(texts)
    a, e, f = digests(texts), digests(edited), digests(following)
    tables = [build(n, *x, CELLS) for x in (a, e, f)]
    sizes = [np.bincount(x[0], minlength=n) for x in (a, e, f)]
    near_edited = likeness(sizes[0], sizes[1], differences(n, a, e, (tables[0], tables[1])))
    near_next = likeness(sizes[0], sizes[2], differences(n, a, f, (tables[0], tables[2])))
    return tables[0].strings(), tables[1].strings(), near_edited, near_next


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the code points gives way to as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, rows_per_bucket: int = 4_000, bytes_per_bucket: int = 1 << 23, batch_chars: int = 1 << 21) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the next row by doc_id (rows that share one, null among them first, follow in the order of
    their text's hash), and the first after the last. Texts go to buckets by ranges of doc_id, and of the text's hash
    where one doc_id fills buckets; the first row of each goes to the one before it as well, so one exchange of the
    texts gives every row its successor. A bucket is read as a stream, so above 200,000 buckets they get longer, not
    heavier; below, they follow the rows and the bytes. Null texts are empty ones, and their fingerprint is that of no passages. Repeated rows come out each; an
    only row is its own next one; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    low = -(2**63)
    at = F.coalesce("doc_id", F.lit(low))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # by rows and by bytes, and enough for all cores where there are rows
    n_buckets = max(1, min(200_000, n, max(n // rows_per_bucket + 1, size // bytes_per_bucket + 1, 4 * spark.sparkContext.defaultParallelism)))
    cuts = np.zeros(0, np.int64)
    if n_buckets > 1:
        found = rows.select(at.alias("at")).agg(F.percentile_approx("at", [i / n_buckets for i in range(1, n_buckets)], F.lit(max(10_000, 4 * n_buckets)))).first()[0]
        cuts = np.sort(np.array(found or [], np.int64))
    shared = spark.sparkContext.broadcast(cuts)

    def bucket_of(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Cuts below an id count, and as large a share of those at it as of all hashes is below its text's."""
        below, upto = (np.searchsorted(shared.value, ids, side) for side in ("left", "right"))
        same = upto - below
        share = (h.astype(np.float64) + 2.0**63) / 2.0**64
        return np.where(same > 1, below + 1 + np.minimum((share * same).astype(np.int64), same - 1), upto).astype(np.int32)

    split = len(np.unique(cuts)) < len(cuts)  # only then does a bucket depend on the text
    h = F.xxhash64("text") if split else F.lit(0).cast("long")

    @F.pandas_udf("int")
    def bucket_udf(ids: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(ids.to_numpy(np.int64), hs.to_numpy(np.int64)))

    # the first row of each bucket: a row for each bucket, whose number is bounded above
    keyed = rows.select(at.alias("at"), h.alias("h"))
    heads = keyed.select(bucket_udf("at", "h").alias("bucket"), F.struct("at", "h").alias("k")).groupBy("bucket").agg(F.min("k").alias("k")).select("bucket", "k.*").orderBy("bucket").collect()
    before = {(x["at"], x["h"]): heads[i - 1]["bucket"] for i, x in enumerate(heads)}
    heads_at = spark.sparkContext.broadcast((np.array([x["at"] for x in heads], np.int64), before))

    def with_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").fill_null(low).to_numpy(zero_copy_only=False)
            hs = b.column("h").to_numpy()
            yield _rows(b, np.arange(b.num_rows), bucket_of(ids, hs), ids, 0)
            first = [i for i in np.nonzero(np.isin(ids, heads_at.value[0]))[0] if (int(ids[i]), int(hs[i])) in heads_at.value[1]]
            if first:
                yield _rows(b, np.array(first), np.array([heads_at.value[1][int(ids[i]), int(hs[i])] for i in first], np.int32), ids[first], 1)

    def _rows(b: pa.RecordBatch, which: np.ndarray, bucket: np.ndarray, ids: np.ndarray, ahead: int) -> pa.RecordBatch:
        part = b.take(pa.array(which))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(which), ahead, np.int8)), pa.array(ids), part.column("doc_id"), part.column("text")], ["bucket", "ahead", "at", "doc_id", "text"])

    dealt = rows.withColumn("h", h).mapInArrow(with_buckets, "bucket int, ahead byte, at long, doc_id long, text string")
    ordered = dealt.repartition(max(len(heads), 1), "bucket").withColumn("h", F.xxhash64("text")).sortWithinPartitions("bucket", "ahead", "at", "h").drop("h", "at")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, str]] = []
        size, prev = 0, None
        for b in batches:
            for bucket, ahead, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))):
                if prev is not None and prev[0] == bucket:
                    held.append((prev[1], prev[2], text))
                    size += 3 * len(text)
                prev = None if ahead else (bucket, doc_id, text)
                if size >= batch_chars:
                    yield _result(held)
                    held, size = [], 0
        if held:
            yield _result(held)

    def _result(held: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        texts, following = [h[1] for h in held], [h[2] for h in held]
        edited = [edited_text(t, f) for t, f in zip(texts, following)]
        own, other, near_edited, near_next = compare_batch(texts, edited, following)
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(own), pa.array(other), pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return ordered.mapInArrow(run, schema)
