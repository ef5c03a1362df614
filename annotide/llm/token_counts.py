"""Token counts by a map-side two-tier lookup.

Texts are cut at ASCII white space, which no token of a white-space-dropping tokenizer crosses, so the count of
a text is the sum over its pre-tokens. Tier one is a compact table of frequent pre-tokens and their lengths,
found by bounded counters over all texts and broadcast once. Tier two is a cache in each Python worker, filled by encoding the misses of a batch together.
No pre-token is ever shuffled; the counts are those of the library whatever the two tiers hold.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens longer than this many bytes are encoded each time and not kept in a worker's cache.
KEEP_BYTES = 64


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encode_lengths(path: str, pieces: list[bytes]) -> list[int]:
    tok = load_tokenizer(path)
    return [len(e) for e in tok.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]


class WorkerCache:
    """Lengths of pre-tokens seen by this worker: the broadcast table plus at most max_entries misses;
    when these are full they are forgotten and gathered anew."""

    def __init__(self, path: str, frequent: tuple[bytes, bytes], max_entries: int):
        words = frequent[0].split()
        self.path, self.max_entries = path, max_entries
        self.frequent = dict(zip(words, memoryview(frequent[1]).cast("H")))
        self.known = dict(self.frequent)

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        known = self.known
        missing = set(chain.from_iterable(split)).difference(known)
        long = {}
        if missing:
            missing = list(missing)
            for piece, n in zip(missing, encode_lengths(self.path, missing)):
                (known if len(piece) <= KEEP_BYTES else long)[piece] = n
        if long:
            out = [sum([known[w] if w in known else long[w] for w in words]) for words in split]
        else:
            out = [sum(map(known.__getitem__, words)) for words in split]
        if len(known) > self.max_entries + len(self.frequent):
            self.known = dict(self.frequent)
        return out


_worker: dict = {}


def _counted(kept: int):
    """The pre-tokens that a task counts most often, from counters of at most eight times as many: when one is full,
    the half that it has counted least are forgotten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(t.encode("utf-8").split())
                if len(seen) > 8 * kept:
                    seen = Counter(dict(seen.most_common(4 * kept)))
        best = [(w, n) for w, n in seen.most_common(kept) if n > 1 and len(w) <= KEEP_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])

    return run


def frequent_table(docs: DataFrame, path: str, table_size: int, per_task: int) -> tuple[bytes, bytes]:
    """The table_size pre-tokens that occur most in all texts, by the counts of what each task counts most, and their
    lengths as 16-bit numbers. It decides only how often tier one answers, never a count. A task tells per_task
    pre-tokens at most."""
    told = docs.select("text").where("text is not null").mapInArrow(_counted(per_task), "word binary, n long")
    words = [bytes(r["word"]) for r in told.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_size).collect()]
    return b" ".join(words), np.array(encode_lengths(path, words), "<u2").tobytes() if words else b""


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, table_size: int = 1 << 15, per_task: int = 1 << 13, cache_entries: int = 1 << 18, batch_bytes: int = 1 << 22) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    tokenizer_path: a tokenizers file whose pre-tokenizer drops white space (no token spans it). Null texts
    count as empty ones: 0 bytes, 0 tokens. Whole texts are counted, whatever their length; repeated rows are
    counted each; other columns are ignored. An empty table gives an empty result.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, tokenizer_path, table_size, per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, cache_entries, zlib.crc32(table.value[0]))
        if _worker.get("key") != key:
            _worker.update(key=key, cache=WorkerCache(tokenizer_path, table.value, cache_entries))
        cache = _worker["cache"]
        for b in batches:
            texts = [t.encode("utf-8") if t else b"" for t in b.column("text").to_pylist()]
            n: list[int] = []
            part: list[bytes] = []
            size = 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size >= batch_bytes:
                    n += cache.counts(part)
                    part, size = [], 0
            n += cache.counts(part)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
