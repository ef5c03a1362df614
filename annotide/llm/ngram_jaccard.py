"""Near-duplicate join on word shingles with Bayesian candidate pruning.

1. Equal texts are one node. MinHash values of each node's shingles give band keys; nodes that share one meet.
2. Where they meet, MinHash values are compared a few at a time, and a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below a tolerance. What survives is told as links
   that connect it, never as all pairs, and its components are narrow clusters of near-equal texts.
3. Each cluster fetches its shingles once, and any two members are verified exactly. Links are counted and the
   classes built from the exact links alone.
Groups of any size are compared as pairs of bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.llm._blocks import block_pairs, group_links, least_labels, whole_groups
from annotide.llm._common import Store, connected_components, keep_possible, own_names, plain_names, text_or_empty
from annotide.llm.fingerprints import mix

N_HASHES = 128
BAND_ROWS = 4  # of 32 bands: a pair at similarity 0.8 shares none of them with a probability below 1e-7
N_BANDS = N_HASHES // BAND_ROWS
STEP = 16
PER_BLOCK = 256

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q = [np.uint64(pow(0xD6E8FEB86659FD93, j, 2**64)) for j in range(64)]


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INV)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of every shingle of width words, in order, repeats included. Words stand between
    ASCII white space. A text of fewer words has them all as its only shingle; one without words has none."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    ends_of_text = np.cumsum(lens)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = 1 << int(len(buf) - 1).bit_length()
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])])
    word = mix((sums[end] - sums[start]) * down[start], 3)
    owner = np.searchsorted(ends_of_text, start, side="right")
    n = len(word)
    total = np.zeros(n, np.uint64)
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    full = np.zeros(n, bool)
    full[: max(n - width + 1, 0)] = owner[: max(n - width + 1, 0)] == owner[width - 1 :]
    for j in range(min(width, n)):
        part = word[j:] * _Q[j]
        same = owner[j:] == owner[: n - j]
        total[: n - j] += np.where(same, part, np.uint64(0))
    keep = full | first
    return owner[keep], mix(total[keep], 9)


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, N_HASHES, np.uint32) | np.uint32(1), rng.integers(0, 2**32, N_HASHES, np.uint32)


def minhash(n: int, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """[n, N_HASHES] least values of the hashes of each text (all ones for a text without shingles)."""
    out = np.full((n, N_HASHES), 0xFFFFFFFF, np.uint32)
    if not len(owner):
        return out
    a, b = _family()
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    who = owner[starts]
    least = np.empty((N_HASHES, len(starts)), np.uint32)
    for i in range(N_HASHES):
        v = (h ^ b[i]) * a[i]
        v ^= v >> np.uint32(15)
        least[i] = np.minimum.reduceat(v, starts)
    out[who] = least.T
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """[n, N_BANDS] 64-bit keys, one for each band."""
    s = sig.reshape(len(sig), N_BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(N_BANDS, dtype=np.uint64)[None, :]
    for r in range(BAND_ROWS):
        key = mix(key + s[:, :, r], 21 + r)
    return key.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Fewest matches of the first STEP, 2 * STEP, ... compared values with which a pair goes on.

    Compared are 8 bits of each value, which agree with probability r = s + (1 - s) / 256 at similarity s. With a
    uniform prior on r, the posterior of r >= r_t after m of n matches is the chance that a binomial of n + 1 trials
    and success r_t is at most m; m has to bring it to the tolerance.
    """
    r = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, N_HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += comb(n + 1, m) * r**m * (1 - r) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(sig: np.ndarray, x: np.ndarray, y: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Numbers of the pairs x, y that are not pruned. A pair that meets in several bands is looked at in each, with
    the same outcome: the few bits here can't tell in which band it met first."""
    live = np.arange(len(x))
    matches = np.zeros(len(live), np.int32)
    for k, m in enumerate(least):
        at = slice(k * STEP, (k + 1) * STEP)
        matches += (sig[x[live], at] == sig[y[live], at]).sum(1, dtype=np.int32)
        go = matches >= m
        live, matches = live[go], matches[go]
        if not len(live):
            break
    return live


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in portions(b.column("text")):
                part = b.slice(lo, hi - lo)
                texts = [t.encode() for t in part.column("text").to_pylist()]
                owner, h = shingles(texts, width)
                sig = minhash(len(texts), owner, h)
                has = np.bincount(owner, minlength=len(texts)) > 0
                keys = band_keys(sig)
                small = (sig & np.uint32(255)).astype(np.uint8)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(has, N_BANDS, 0))]), pa.int32()), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tid"), pa.array([r.tobytes() for r in small], pa.binary()), bands], ["doc_id", "tid", "sig", "bands"])

    return run


def portions(texts: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes of text."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(sizes):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + chars, side="right")))
        yield lo, hi
        lo = hi


def _pruned(threshold: float, tolerance: float):
    """The test of pairs of a table of rows by their signatures."""

    def test_of(rows: pa.Table):
        least = least_matches(threshold, tolerance)
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, N_HASHES)

        def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x), bool)
            out[surviving(sig, x, y, least)] = True
            return out

        return test

    return test_of


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in portions(b.column("text")):
                part = b.slice(lo, hi - lo)
                owner, h = shingles([t.encode() for t in part.column("text").to_pylist()], width)
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                sets = [np.unique(h[cuts[i] : cuts[i + 1]]).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("tid", "mult", "root", "c")), pa.array(sets, pa.binary())], ["tid", "mult", "root", "c", "sh"])

    return run


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the shingles that two sets share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(df > 1) - 1
    keep = df[inverse] > 1
    row, col = row[keep], shared[inverse[keep]]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for k in range(0, int(shared[-1]) + 1 if len(shared) else 0, columns):
        a, z = np.searchsorted(col, [k, k + columns])
        m = np.zeros((n, columns), np.float32)
        m[row[a:z], col[a:z] - k] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return np.rint(out).astype(np.int64)


def _exact_links(threshold: float):
    t_num, t_den = Fraction(str(threshold)).as_integer_ratio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["root", "lo", "hi"], 64):
            lo, hi, own, mult = (t.column(c).to_numpy() for c in ("lo", "hi", "own", "mult"))
            tids, raw = t.column("tid").to_pylist(), t.column("sh").to_pylist()
            who, links, least = [], [], []
            for a, z in zip(at[:-1], at[1:]):
                if z - a < 2:
                    continue
                sets = [np.frombuffer(r, np.uint64) for r in raw[a:z]]
                size = np.array([len(s) for s in sets])
                inter = intersections(sets)
                near = t_den * inter >= t_num * (size[:, None] + size[None, :] - inter)
                np.fill_diagonal(near, False)
                if lo[a] != hi[a]:
                    near &= own[a:z, None] != own[None, a:z]
                x, y = np.nonzero(near)
                label = least_labels(z - a, x, y)
                count = near @ mult[a:z]
                for i in np.nonzero(count)[0]:
                    who.append(tids[a + i])
                    links.append(int(count[i]))
                    least.append(tids[a + label[i]])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.binary()), pa.array(links, pa.int64()), pa.array(least, pa.binary())], ["tid", "links", "to"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, tid (md5 of the text), class_id and n_links for every row of docs.

    Two texts are linked if the Jaccard similarity of their sets of width-word shingles is threshold or more; n_links
    counts the other rows with a linked or equal text, and class_id is the least doc_id of those connected by links.
    A null text, and one without words, has no shingles, no links and its own doc_id as class, even where others are
    equal to it. Texts of fewer words than width are linked to those of the same words. Repeated rows are copies of
    each other. Columns besides doc_id and text are ignored; an empty table gives an empty result.
    """
    store = Store(docs.sparkSession, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    members = store.put(rows.select("doc_id", "tid"))
    signed = rows.mapInArrow(_signatures(width), "doc_id long, tid binary, sig binary, bands array<long>")
    nodes = store.put(signed.groupBy("tid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))

    banded = nodes.select("tid", F.explode("bands").alias("key"))
    met = store.put(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    largest = met.agg(F.max("m")).first()[0] or 0
    meeting = banded.join(met, "key").join(nodes.select("tid", "sig"), "tid")
    clusters = connected_components(store, group_links(store, meeting, "key", "m", "tid", PER_BLOCK, _pruned(threshold, tolerance), largest))

    sizes = clusters.groupBy("root").agg(F.count("*").alias("c"))
    placed = store.put(clusters.join(sizes, "root").join(nodes.select("tid", "rep", "mult"), F.col("node") == F.col("tid")).select("tid", "rep", "mult", "root", "c"))
    p = placed.withColumnRenamed("tid", "p_tid")
    # most texts are in no cluster and need not be dealt out
    fetched = keep_possible(store, rows, placed, "tid").join(p, (rows.tid == p.p_tid) & rows.doc_id.eqNullSafe(p.rep)).groupBy("tid", "rep").agg(*(F.first(c).alias(c) for c in ("mult", "root", "c", "text")))
    sets = fetched.select("tid", "mult", "root", "c", "text").mapInArrow(_shingle_sets(width), "tid binary, mult long, root binary, c long, sh binary")
    dealt = block_pairs(sets, "root", F.col("c"), "tid", PER_BLOCK).select("root", "lo", "hi", "own", "tid", "mult", "sh")
    exact = store.put(dealt.mapInArrow(_exact_links(threshold), "tid binary, links long, to binary"))
    store.drop(placed)

    counted = exact.groupBy("tid").agg(F.sum("links").alias("links"))
    classes = connected_components(store, exact.select(F.col("tid").alias("a"), F.col("to").alias("b")))
    reps = classes.join(nodes.select("tid", "rep"), F.col("node") == F.col("tid"))
    class_ids = reps.groupBy("root").agg(F.min("rep").alias("class_id"))
    of_node = reps.join(class_ids, "root").select("tid", "class_id")
    has_words = F.size("bands") > 0
    info = nodes.join(counted, "tid", "left").join(of_node, "tid", "left").select(
        "tid",
        F.when(has_words, F.coalesce("class_id", "rep")).alias("class_id"),
        F.when(has_words, F.coalesce("links", F.lit(0)) + F.col("mult") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    return members.join(store.put(info), "tid").select("doc_id", "tid", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class of near-duplicates: the one of least doc_id (of equal ids, of least md5 of the
    text). Rows without links stay, also repeated ones without words. Columns stay as they are."""
    store = Store(docs.sparkSession, "kept")
    linked = store.put(near_duplicates(docs, width, threshold).where("n_links > 0"))
    kept = linked.groupBy("class_id").agg(F.min(F.struct("doc_id", "tid")).alias("k")).select("k.*").withColumn("stays", F.lit(True))
    counted = linked.groupBy("doc_id", "tid").agg(F.count("*").alias("n")).withColumnsRenamed({"doc_id": "d", "tid": "t"})
    verdicts = counted.join(kept, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid")), "left")
    verdicts = store.put(verdicts.select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("n").alias("_n"), F.coalesce("stays", F.lit(False)).alias("_stays")))
    docs, names = plain_names(docs)
    tid = F.unhex(F.md5(text_or_empty(names["text"])))
    out = docs.withColumn("_tid", tid).join(verdicts, F.col(names["doc_id"]).cast("long").eqNullSafe(F.col("_d")) & (F.col("_tid") == F.col("_t")), "left").where(F.coalesce("_stays", F.lit(True)))
    if verdicts.where("_stays and _n > 1").limit(1).count():  # kept rows that are repeated as they are
        once = out.where("_n > 1").dropDuplicates(["_d", "_t"])
        out = out.where(F.coalesce(F.col("_n"), F.lit(1)) == 1).unionByName(once)
    return out.select(*own_names(names))
