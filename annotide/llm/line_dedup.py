"""Line deduplication by a segment-partition edit join.

Lines fall into classes of like length, in which the edits allowed are the same, and are split into one segment more
than these: those of the front half stand at fixed places from the start, those of the back half from the end. Two
lines within the edits share a segment that has no more edits before it than segments stand before it, and no more
behind it than segments behind it; so a line probes few shifts of each segment, in its own class and in those of
shorter lines within its reach. A segment is known by its least k-gram, which shifts by a few characters often share.
Lines that meet under a key and whose character counts allow it are verified with a banded bit-parallel edit distance:
pair by pair, or, where copies of a line meet, together. Lines joined by verified links, and equal ones, are a class;
its first line in the order of documents stays and the others go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotide.llm._blocks import Test, _all_pairs, group_links, links_within, spans, triangle, with_first
from annotide.llm._common import Store, connected_components, keep_possible, own_names, plain_names, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
BINS = 21  # of two bits in the sketch of each end of a line
# of a row's three numbers, the key's lowest 16 bits hold whether it is indexed and the line's length, the id's lowest 20
# the first 10 bins, and the third all others
KEY_BITS, ID_BITS, ID_BINS = 16, 20, 10
LEAST_GRAM = 9
PER_BLOCK = 2048
BLOCK_BYTES = 1 << 22
PORTION_CHARS = 1 << 20
COUNTED_CHARS = 1 << 18
TESTED_PAIRS = 1 << 16
SEEN_LINES = 1 << 17
VERIFIED_BYTES = 1 << 22
PACKED_ROWS = 1 << 19
HELD_ROWS = 1 << 21
_ONE = np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def edits(length, threshold: int, percent: int):
    """Most edits between two lines, the shorter of that length: the threshold, or that share of the length if less."""
    return np.minimum(length * percent // 100, threshold)


def length_classes(threshold: int, percent: int, least: int, longest: int) -> list[tuple[int, int, int]]:
    """Shortest line, end and edits of each class of lengths from least to longest. A class holds one number of edits,
    and its lines differ by about a quarter in length; lines that are too short for a segment more than edits are in none."""
    lo = max(least, 2)
    while edits(lo, threshold, percent) < 1 and lo <= longest:
        lo += 1
    out = []
    while lo <= longest:
        most = int(min(edits(lo, threshold, percent), lo - 1))
        hi = lo + max(lo // 4, min(lo // 2, 10))
        if most < threshold:
            hi = next((x for x in range(lo + 1, hi) if min(edits(x, threshold, percent), x - 1) > most), hi)
        out.append((lo, hi, most))
        lo = hi
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INV)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash for every window of size code points: its least k-gram's, with k about half the size, and LEAST_GRAM or more
    if the size allows it. Equal windows have equal hashes wherever they stand, and neighbours often the same one."""
    k = max(min(size, LEAST_GRAM), (size + 1) // 2)
    n = len(codes)
    up, down = _powers(1 << int(n).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + _ONE) * up[:n])])
    least = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    have, width = 1, size - k + 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _class_keys(lines: list[str], threshold: int, percent: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each class of lengths: the lines in its reach, their number, the key, and whether it is indexed; then the
    code points of the lines in reach and half the class's least length."""
    size = np.array([len(s) for s in lines], np.int64)
    for number, (lo, hi, most) in enumerate(length_classes(threshold, percent, least, int(size.max(initial=0)))):
        who = np.nonzero((size >= lo) & (size - most < hi))[0]
        if not len(who):
            continue
        n = size[who]
        start = np.cumsum(n) - n
        own = n < hi
        z = lo // (most + 1)
        codes = np.frombuffer("".join([lines[w] for w in who]).encode("utf-32-le", "replace"), np.uint32)
        windows = window_hashes(codes, z)
        owners, keys, indexed = [], [], []
        for i in range(most + 1):
            front = 2 * i <= most
            reach = i if front else most - i
            base = start + i * z if front else start + n - (most + 1 - i) * z
            at = np.arange(-reach, reach + 1)[:, None] + base
            np.maximum(at, start, out=at)
            np.minimum(at, start + n - z, out=at)
            found = windows[at]  # shifts that share a k-gram stand side by side
            new = np.ones(found.shape, bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            # values are hashes already; segments of classes are told apart
            keys.append((found[new] ^ _mix(np.array([number * 64 + i + 1], np.uint64))).view(np.int64))
            owners.append(np.broadcast_to(np.arange(len(who)), found.shape)[new])
            indexed.append((own & (found == found[reach]))[new])
        yield who, np.concatenate(owners), np.concatenate(keys), np.concatenate(indexed), codes, lo // 2


def segment_keys(lines: list[str], threshold: int, percent: int = 100, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line number, key, and whether the line is indexed under it or only probes it; a key seldom comes twice for a line.

    Of the segment i of most + 1, the shifts from -i to i are probed in front, and from i - most to most - i at the back.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    found += [(who[owner], key, indexed) for who, owner, key, indexed, *_ in _class_keys(lines, threshold, percent, least)]
    return tuple(np.concatenate(c) for c in zip(*found))


def _end_counts(codes: np.ndarray, size: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters in the first half and the last half code points of each line, modulo 4, by bins; each as a
    Gray code, so that two counts differ in as many bits as they lie apart. The first ID_BINS, and the other bins."""
    bin_of = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(16)) * np.uint32(BINS) >> np.uint32(16)  # neighbours in the alphabet lie apart
    end = np.cumsum(size)
    row = np.arange(len(size))[:, None] * (2 * BINS)
    inside = np.arange(half)
    counts = np.bincount((row + bin_of[(end - size)[:, None] + inside]).ravel(), minlength=len(size) * 2 * BINS)
    counts += np.bincount((row + BINS + bin_of[(end - half)[:, None] + inside]).ravel(), minlength=len(size) * 2 * BINS)
    counts = (counts & 3).astype(np.uint64).reshape(-1, 2 * BINS)
    bits = (counts ^ (counts >> _ONE)) << (2 * np.concatenate([np.arange(ID_BINS), np.arange(2 * BINS - ID_BINS)])).astype(np.uint64)
    return bits[:, :ID_BINS].sum(1).view(np.int64), bits[:, ID_BINS:].sum(1).view(np.int64)


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length (15 bits; all longer ones as one, above a free bit), and counts of the ends of lines, as long as half the
    shortest one."""
    size = np.array([len(s) for s in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)
    return np.minimum(size, 0x7FFF) << 1, *_end_counts(codes, size, int(min(size, default=0)) // 2)


def like_sketches(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray, threshold: int, percent: int) -> Test:
    """The test whether two rows of lines, one of them indexed under the key where they meet, may be within the edits allowed."""
    indexed, size = (key & 1).astype(bool), ((key >> 1) & 0x7FFF).astype(np.int16)
    allowed = edits(size.astype(np.int64), threshold, percent).astype(np.int16)  # grows with the length, so the shorter line has the least
    few = ids & ((1 << 2 * ID_BINS) - 1)

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.minimum(allowed[x], allowed[y])
        ok = np.nonzero((indexed[x] | indexed[y]) & (np.abs(size[x] - size[y]) <= most))[0]
        # the ends of a line don't overlap; an edit falls into one of them or between, and there changes two counts by one
        # at most: its own character's and that of the one which it moves over the border
        moved, most = _bits_apart(sketch[x[ok]], sketch[y[ok]]), 2 * most[ok]
        near = moved <= most
        ok, moved, most = ok[near], moved[near], most[near]
        out = np.zeros(len(x), bool)
        out[ok] = moved + _bits_apart(few[x[ok]], few[y[ok]]) <= most
        return out

    return test


def _bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16)


def banded_distance(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of columns a[:n[i], i] and b[:m[i], i], m[i] from n[i] - band to n[i], in step over all columns;
    exact up to band, above it only known to be above. One 64-bit word per pair holds the vertical differences of the
    band's 2 * band + 1 diagonals, its top bit being the lowest diagonal (band below 31). Values of a beyond n are none
    that b has. Pairs go as soon as they end, or as no cell of their band can be within it any more."""
    out = np.full(len(n), band + 1, np.int64)
    who = np.arange(len(n))
    vp = np.full(len(n), ((1 << (band + 1)) - 1) << (63 - band), np.uint64)
    vn = np.zeros(len(n), np.uint64)
    dist = np.full(len(n), band, np.int64)
    top = np.uint64(1 << 63)
    in_band = np.uint64(((1 << (2 * band + 2)) - 1) << (62 - 2 * band))
    mark = np.full(len(n), 1 << 62, np.uint64)
    bits = np.array([1 << (k & 7) for k in range(2 * band + 1)], np.uint8)[:, None]
    all_down = int((n - band).min(initial=0))
    none = np.full((band, len(n)), np.iinfo(a.dtype).max, a.dtype)
    padded = np.concatenate([none, a, none, none[:1]])
    for j in range(b.shape[0]):
        equal = (padded[j : j + 2 * band + 1] == b[j]).view(np.uint8) * bits
        match = np.zeros(len(n), np.uint64)
        for k in range(0, 2 * band + 1, 8):
            match |= np.bitwise_or.reduce(equal[k : k + 8], axis=0).astype(np.uint64) << np.uint64(63 - 2 * band + k)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        if j < all_down:
            dist += (~d0 >> np.uint64(63)).view(np.int64)
        else:
            on = j < m
            down = j < n - band
            dist += on & down & ((d0 & top) == 0)
            across = on & ~down
            dist += np.where(across, ((hp & mark) != 0).astype(np.int64) - ((hn & mark) != 0).astype(np.int64), 0)
            mark = np.where(across, mark >> _ONE, mark)
        vp = hn | ~((d0 >> _ONE) | hp)
        vn = hp & (d0 >> _ONE)
        if j % 8 == 7:
            # above the lowest cell values fall by one for each rise at most
            ended, far = j + 1 >= m, dist - np.bitwise_count(vp & in_band) > band
            out[who[ended]] = dist[ended]
            if 8 * (stay := np.nonzero(~(ended | far))[0]).size < 7 * len(n):
                if not len(stay):
                    return out
                who, vp, vn, dist, mark, n, m, padded, b = who[stay], vp[stay], vn[stay], dist[stay], mark[stay], n[stay], m[stay], padded[:, stay], b[:, stay]
                all_down = int((n - band).min())
    out[who] = np.where(dist - np.bitwise_count(vp & in_band) > band, out[who], dist)
    return out


def within(lines: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: int, percent: int = 100, cells: int = 1 << 21) -> np.ndarray:
    """Whether lines x[i] and y[i] are within the edits allowed, a portion of one number of edits and like lengths at a time."""
    size = np.array([len(s) for s in lines], np.int64)
    flat = np.concatenate([*lines, np.zeros(1, np.uint32)])
    start = (np.cumsum(size) - size).astype(np.int32 if len(flat) < 1 << 30 else np.int64)
    if flat.max() < 0xFFFF:
        flat = flat.astype(np.uint16)

    def columns(who: np.ndarray) -> np.ndarray:
        at = np.arange(max(size[who].max(), 1), dtype=start.dtype)[:, None]
        out = flat[np.minimum(start[who] + at, start.dtype.type(len(flat) - 1))]
        out[at >= size[who]] = np.iinfo(flat.dtype).max
        return out

    out = np.zeros(len(x), bool)
    most = edits(np.minimum(size[x], size[y]), threshold, percent) if percent < 100 else np.full(len(x), threshold)
    near = np.nonzero(np.abs(size[x] - size[y]) <= most)[0]
    near = near[np.lexsort((size[x[near]], most[near]))]
    at = 0
    while at < len(near):
        band = int(most[near[at]])
        n_like = int(np.searchsorted(most[near[at:]], band, side="right"))
        width = size[x[near[at : at + n_like]]] + band + 1
        fits = width * np.arange(1, n_like + 1) <= cells
        z = at + max(int(fits.sum()) if fits.all() else int(fits.argmin()), 1)
        part = near[at:z]
        swap = size[x[part]] < size[y[part]]
        longer, shorter = np.where(swap, y[part], x[part]), np.where(swap, x[part], y[part])
        out[part] = banded_distance(columns(longer), columns(shorter), size[longer], size[shorter], band) <= band
        at = z
    return out


def cuts_allow(lines: list[np.ndarray], x: np.ndarray, y: np.ndarray, most: np.ndarray, bins: int = 32) -> np.ndarray:
    """Which pairs of lines x[i], y[i] may be most[i] edits or fewer apart: cut anywhere, so that the characters before the
    cut are counted from the start and those behind it from the end, their counts differ by two for each edit at most.
    Lines are cut into eighths of their length in whole 32 characters; shorter ones, and pairs of other lengths, may all be."""
    size = np.array([len(s) for s in lines], np.int64)
    base = size // 32 * 32
    who = np.nonzero(base >= 64)[0]
    at = np.cumsum(base >= 64) - 1
    front, back = np.zeros((2, len(who), 7, bins), np.uint8)
    for a, z in spans(size[who], COUNTED_CHARS):
        n = size[who[a:z]]
        row = np.repeat(np.arange(z - a), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bin_of = (np.concatenate([lines[w] for w in who[a:z]]) * np.uint32(0x9E3779B1) >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)
        length = base[who[a:z]][row]
        for out, from_end in ((front, place), (back, n[row] - 1 - place)):
            inside = from_end < length
            part = (row[inside] * 8 + from_end[inside] * 8 // length[inside]) * bins + bin_of[inside]
            out[a:z] = np.bincount(part, minlength=(z - a) * 8 * bins).reshape(-1, 8, bins).cumsum(1)[:, :7] & 255
    ok = np.ones(len(x), bool)
    cut = np.nonzero((base[x] == base[y]) & (base[x] >= 64))[0]
    for k in (3, 1, 5, 0, 2, 4, 6):
        i, j = at[x[cut]], at[y[cut]]
        moved = sum(np.abs((c[i, e] - c[j, e]).view(np.int8)).sum(1, dtype=np.int16) for c, e in ((front, k), (back, 6 - k)))
        near = moved <= 2 * most[cut]
        ok[cut[~near]] = False
        cut = cut[near]
    return ok


def like_pairs(lines: list[np.ndarray], threshold: int, percent: int, bins: int = 64) -> Test:
    """The test whether lines are within the edits allowed: pairs whose counts of two-character strings (hashed to bins)
    differ by more than the edits can explain are not compared."""
    size = np.array([len(s) for s in lines], np.int64)
    counts = np.zeros((len(lines), bins), np.uint8)
    for a, z in spans(size, COUNTED_CHARS):
        owner = np.repeat(np.arange(z - a), size[a:z])
        flat = np.concatenate(lines[a:z])
        two = (flat[:-1] * np.uint32(0x9E3779B1) + flat[1:]) * np.uint32(0x85EBCA6B)
        inside = owner[:-1] == owner[1:]
        n = np.bincount(owner[:-1][inside] * bins + (two[inside] >> np.uint32(16)) % np.uint32(bins), minlength=(z - a) * bins)
        counts[a:z] = n.reshape(-1, bins) & 255

    def portion(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = edits(np.minimum(size[x], size[y]), threshold, percent)
        maybe = np.nonzero(np.abs(size[x] - size[y]) <= most)[0]
        # an edit takes two such strings away and adds two at most (the counts are kept modulo 256)
        moved = np.abs((counts[x[maybe]] - counts[y[maybe]]).view(np.int8)).sum(1, dtype=np.int16)
        maybe = maybe[moved <= 4 * most[maybe]]
        out = np.zeros(len(x), bool)
        if len(maybe):
            used, at = np.unique(np.concatenate([x[maybe], y[maybe]]), return_inverse=True)
            some, x, y = [lines[i] for i in used], at[: len(maybe)], at[len(maybe) :]
            left = cuts_allow(some, x, y, most[maybe])
            out[maybe[left]] = within(some, x[left], y[left], threshold, percent)
        return out

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        parts = [slice(at, at + TESTED_PAIRS) for at in range(0, len(x), TESTED_PAIRS)]
        return np.concatenate([np.zeros(0, bool), *(portion(x[p], y[p]) for p in parts)])

    return test


def code_points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)


def line_ids(lines: pa.Array) -> list[bytes]:
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1].tolist() if len(lines) else [0]
    data = memoryview(data or b"")
    return [xxhash.xxh3_128_digest(data[a:z]) for a, z in zip(at, at[1:])]


def short_ids(ids: list[bytes]) -> np.ndarray:
    """The first 44 bits of line ids, above zeros. They only serve to find candidates: which lines are equal is told by whole ids."""
    return np.frombuffer(b"".join(ids), np.int64)[::2] >> ID_BITS << ID_BITS


def _numbered(texts: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Row numbers, line numbers and lines of least characters or more, without the white space around them, in portions
    of whole texts of about PORTION_CHARS bytes."""
    for at, z in spans(pc.binary_length(texts).to_numpy(zero_copy_only=False), PORTION_CHARS):
        split = pc.split_pattern(texts.slice(at, z - at), "\n")
        lines = pc.ascii_trim(split.flatten(), characters=BLANKS)
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, numbers = np.repeat(np.arange(at, z), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        long = np.nonzero(pc.utf8_length(lines).to_numpy(zero_copy_only=False) >= least)[0]
        yield rows[long], numbers[long], lines.take(pa.array(long))


def _places(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, numbers, lines in _numbered(b.column("text"), least):
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("dh").take(at), pa.array(numbers, pa.int32()), pa.array(line_ids(lines), pa.binary())], ["doc_id", "dh", "line_no", "lid"])

    return run


class _Seen:
    """Lines that a task has had, as far as SEEN_LINES of them are remembered; repeated lines are told once by each."""

    def __init__(self):
        self.ids: set[bytes] = set()

    def new(self, lines: pa.Array) -> tuple[pa.Array, list[bytes]]:
        fresh = {i: k for k, i in enumerate(line_ids(lines)) if i not in self.ids}
        if len(self.ids) + len(fresh) > SEEN_LINES:
            self.ids.clear()
        self.ids.update(fresh)
        return lines.take(pa.array(list(fresh.values()), pa.int32())), list(fresh)


def _packed(held: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """Rows of key, id and sketch by the bucket of their key, each bucket's as one value. held: portions of keys and
    their line's number, and of the ids and sketches of lines."""
    owner, key, ids, sketch = (np.concatenate(c) for c in zip(*held))
    bucket = ((key >> KEY_BITS & 0xFFFFFFFF).astype(np.uint32) % np.uint32(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    owner = owner[order]
    rows = np.empty((len(order), 3), np.int64)
    rows[:, 0], rows[:, 1], rows[:, 2] = key[order], ids[owner], sketch[owner]
    first = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
    offsets = np.append(first, len(rows)) * (3 * rows.itemsize)
    values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), values], ["bucket", "rows"])


def _keyed(threshold: int, percent: int, least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        held, n, n_lines = [], 0, 0
        for b in batches:
            for _, _, lines in _numbered(b.column("text"), max(least, 1)):
                new, ids = seen.new(lines)
                if not ids:
                    continue
                lines, ids = new.to_pylist(), short_ids(ids)
                length = np.array([len(s) for s in lines], np.int64)
                for who, owner, key, indexed, codes, half in _class_keys(lines, threshold, percent, least):
                    few, many = _end_counts(codes, length[who], half)
                    key = key >> KEY_BITS << KEY_BITS | np.minimum(length[who], 0x7FFF)[owner] << 1 | indexed
                    held.append((owner + n_lines, key, ids[who] | few, many))
                    n, n_lines = n + len(key), n_lines + len(who)
                if n >= PACKED_ROWS:
                    yield _packed(held, buckets)
                    held, n, n_lines = [], 0, 0
        if n:
            yield _packed(held, buckets)

    return run


def _unpacked(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[1]].view(np.int64).reshape(-1, 3)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their keys, indexed ones first, those of a key and line that came from several tasks once,
    with the number of rows that each one's key has. Keys that only one row brings, or that no line is indexed under, go."""
    group = rows[:, 0] >> KEY_BITS
    order = np.argsort(group)
    group = group[order]
    at = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
    sizes = np.diff(np.append(at, len(rows)))
    meet = np.repeat((sizes > 1) & (np.add.reduceat(rows[order, 0] & 1, at) > 0), sizes)
    rows = rows[order[meet]]
    key = rows[:, 0]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], key >> KEY_BITS << KEY_BITS | (~key & 1) << 15 | (key >> 1) & 0x7FFF))]
    rows = rows[np.concatenate([np.ones(min(len(rows), 1), bool), (rows[1:] != rows[:-1]).any(1)])]
    _, n = np.unique(rows[:, 0] >> KEY_BITS, return_counts=True)
    return rows, np.repeat(n, n)


def _bucket_rows(batches: Iterator[pa.RecordBatch], limit: int, least_rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of keys that up to limit distinct rows have, whole keys in order, and rows of keys that more have. Buckets come
    one after the other; of one that holds more than HELD_ROWS, rows of keys with more than limit rows go on at once."""
    none = np.zeros((0, 3), np.int64)
    held, n, last, most, hot = [], 0, None, HELD_ROWS, np.zeros(0, np.int64)
    for b in batches:
        bucket = b.column("bucket").to_numpy()
        cuts = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(bucket)]])
        for a, z in zip(cuts[:-1], cuts[1:]):
            if bucket[a] != last and last is not None and (n >= least_rows or len(hot)):
                rows, sizes = _distinct(np.concatenate(held))
                yield rows[sizes <= limit], rows[sizes > limit]
                held, n, most, hot = [], 0, HELD_ROWS, hot[:0]
            last = bucket[a]
            rows = _unpacked(b.column("rows").slice(a, z - a))
            if len(hot):
                is_hot = np.isin(rows[:, 0] >> KEY_BITS, hot)
                yield none, rows[is_hot]
                rows = rows[~is_hot]
            held.append(rows)
            n += len(rows)
            if n > most:
                rows = np.unique(np.concatenate(held), axis=0)
                keys, counts = np.unique(rows[:, 0] >> KEY_BITS, return_counts=True)
                hot = np.concatenate([hot, keys[counts > limit]])
                is_hot = np.repeat(counts > limit, counts)
                yield none, rows[is_hot]
                held, n = [rows[~is_hot]], int((~is_hot).sum())
                most = max(HELD_ROWS, 2 * n)
    if held:
        rows, sizes = _distinct(np.concatenate(held))
        yield rows[sizes <= limit], rows[sizes > limit]


def _pairs_within(sizes: np.ndarray, indexed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups whose first row is one of the first indexed rows, those of like small groups at once."""
    start = np.cumsum(sizes) - sizes
    small = np.nonzero((sizes > 1) & (sizes <= 64))[0]
    kind = (sizes[small] << 8 | indexed[small]).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    small, kind = small[order], kind[order]
    at = np.nonzero(np.concatenate([np.ones(min(len(kind), 1), bool), kind[1:] != kind[:-1]]))[0]
    xs, ys, held = [], [], 0
    for k, a, z in zip(kind[at].tolist(), at, np.append(at[1:], len(small))):
        x, y = _all_pairs(k >> 8)
        n = int(np.searchsorted(x, k & 255))
        step = max((1 << 17) // max(n, 1), 1)
        for i in range(a, z, step):
            of = start[small[i : min(i + step, z)], None]
            xs.append((of + x[:n]).ravel())
            ys.append((of + y[:n]).ravel())
            held += len(xs[-1])
            if held >= 1 << 16:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys)
    for g in np.nonzero(sizes > 64)[0]:
        for x, y in triangle(int(sizes[g]), int(indexed[g])):
            yield start[g] + x, start[g] + y


def group_candidates(at: np.ndarray, indexed: np.ndarray, test: Test, dense: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that pass the test (one of the two is always among its group's first indexed rows), and links that connect the rows of groups where more than dense pairs a row do.

    Most groups hold few such pairs, each of which can be verified by itself. Copies of one line hold nearly all of
    theirs; there only links to the first row come out, and what they connect is verified together.
    """
    sizes = np.diff(at)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    copies = np.zeros(len(sizes), bool)
    for g in np.nonzero(sizes > 4 * dense)[0]:
        others = np.arange(at[g] + 1, at[g + 1])
        copies[g] = test(np.full(len(others), at[g]), others).sum() > max(2 * dense, len(others) // 8)
    rest = ~copies & (sizes > 1)
    rows = np.nonzero(np.repeat(rest, sizes))[0]
    found = np.zeros(len(sizes), np.int64)
    for x, y in _pairs_within(sizes[rest], indexed[rest]):
        x, y = rows[x], rows[y]
        ok = test(x, y)
        x, y = x[ok], y[ok]
        group = np.searchsorted(at, x, side="right") - 1
        found += np.bincount(group, minlength=len(sizes))
        few = found[group] <= dense * sizes[group]  # pairs of other groups are not needed, and may be many
        xs.append(x[few])
        ys.append(y[few])
    x, y = np.concatenate(xs), np.concatenate(ys)
    copies |= found > dense * sizes
    few = ~copies[np.searchsorted(at, x, side="right") - 1]
    label = np.arange(at[-1])
    for g in np.nonzero(copies)[0]:
        label[at[g] : at[g + 1]] = at[g] + links_within(sizes[g], with_first(np.array([0, sizes[g]])), lambda x, y, a=at[g]: test(x + a, y + a))
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return x[few], y[few], moved, label[moved]


def _met_by_key(threshold: int, percent: int, limit: int):
    """a, b within the groups of a key, told with whether they are one pair or stand for many; rows of groups of more
    than limit rows come out as key, id, sketch."""

    def result(a, b, many, rest: np.ndarray) -> pa.RecordBatch:
        columns = [pa.concat_arrays([pa.array(v, kind), pa.nulls(len(rest), kind)]) for v, kind in ((a, pa.int64()), (b, pa.int64()), (many, pa.bool_()))]
        columns += [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.ascontiguousarray(rest[:, c]))]) for c in range(3)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "many", "key", "id", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, large in _bucket_rows(batches, limit):
            if not len(rows):
                yield result([], [], [], large)
                continue
            key, ids, sketch = np.ascontiguousarray(rows.T)
            group = key >> KEY_BITS
            cuts = np.concatenate([[0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(key)]])
            x, y, moved, to = group_candidates(cuts, np.add.reduceat(key & 1, cuts[:-1]), like_sketches(key, ids, sketch, threshold, percent))
            ids = ids >> ID_BITS << ID_BITS
            a, b = np.concatenate([ids[x], ids[moved]]), np.concatenate([ids[y], ids[to]])
            yield result(np.minimum(a, b), np.maximum(a, b), np.arange(len(a)) >= len(x), large)

    return run


def _verified(threshold: int, percent: int):
    """Links a, b of lines that are near the line whose id is at. Rows come in the order of at, those of that line first:
    they are kept while the group's other rows come in portions of about VERIFIED_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            for first, end in spans(pc.binary_length(b.column("line")).to_numpy(zero_copy_only=False), VERIFIED_BYTES):
                t = pa.Table.from_batches([*kept, b.slice(first, end - first)]).combine_chunks()
                old = sum(k.num_rows for k in kept)
                ids, at = t.column("id").to_numpy(), t.column("at").to_numpy()
                cuts = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1, [len(at)]])
                centre = np.nonzero(ids == at)[0]
                group = np.searchsorted(cuts, centre, side="right") - 1
                n = np.diff(cuts)[group]
                x, y = np.repeat(centre, n), np.arange(n.sum()) + np.repeat(cuts[group] - np.cumsum(n) + n, n)
                new = (x != y) & (np.maximum(x, y) >= old)
                x, y = x[new], y[new]
                ok = like_pairs([code_points(s) for s in t.column("line").to_pylist()], threshold, percent)(x, y)
                lid = t.column("lid")
                yield pa.RecordBatch.from_arrays([lid.take(pa.array(x[ok])).combine_chunks(), lid.take(pa.array(y[ok])).combine_chunks()], ["a", "b"])
                kept = t.take(pa.array(centre[at[centre] == at[-1]])).to_batches()

    return run


def _fetched(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for b in batches:
            for _, _, lines in _numbered(b.column("text"), max(least, 1)):
                lines, ids = seen.new(lines)
                yield pa.RecordBatch.from_arrays([pa.array(short_ids(ids)), pa.array(ids, pa.binary()), lines], ["id", "lid", "line"])

    return run


def line_classes(store: Store, rows: DataFrame, places: DataFrame, threshold: int, edit_chars: int = 0, percent: int = 100, in_task: int = 1 << 14) -> DataFrame:
    """lid, root (the class's least lid) of every line whose class holds more than one line.

    rows: doc_id, dh, text. Groups of a key up to in_task lines are compared where they meet, larger ones in blocks.
    """
    repeated = store.put(places.groupBy("lid").agg(F.count("*").alias("n")).where("n > 1").select("lid", F.col("lid").alias("root")))
    if not threshold:
        return repeated
    buckets = min(8 * int(store.spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    keys = rows.select("text").mapInArrow(_keyed(threshold, percent, edit_chars, buckets), "bucket int, rows binary")
    met = store.put(keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met_by_key(threshold, percent, in_task), "a long, b long, many boolean, key long, id long, sketch long"))
    pairs = store.put(met.where("not many").select("a", "b").distinct())
    links = met.where("many").select("a", "b")
    large = met.where("key is not null").select("key", "id", "sketch").distinct()
    if large.limit(1).count():
        line = F.shiftleft(F.shiftright("id", ID_BITS), ID_BITS)
        large = store.put(large.select(F.shiftright("key", KEY_BITS).alias("group"), line.alias("line"), "key", "id", "sketch"))
        sized = large.join(large.groupBy("group").agg(F.count("*").alias("m")), "group")
        links = links.unionByName(group_links(store, sized, "group", "m", "line", PER_BLOCK, lambda t: like_sketches(*(t.column(c).to_numpy() for c in ("key", "id", "sketch")), threshold, percent)))
    clusters = store.put(connected_components(store, links))
    store.drop(met)

    # where a line is needed: with each line that it may be near, and in its cluster; most are needed nowhere
    needed = pairs.select(F.col("b").alias("id"), F.col("a").alias("at"), F.lit(False).alias("whole")).unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("at"), F.lit(False).alias("whole")).distinct())
    needed = store.put(needed.unionByName(clusters.select(F.col("node").alias("id"), F.col("root").alias("at"), F.lit(True).alias("whole"))))
    fetched = keep_possible(store, rows.select("text").mapInArrow(_fetched(edit_chars), "id long, lid binary, line string"), needed, "id")
    fetched = fetched.groupBy("id", "lid").agg(F.first("line").alias("line"))  # a line comes once from each task
    fetched = store.put(fetched.join(needed, "id"))
    stars = fetched.where("not whole").select("at", "id", "lid", "line").repartition("at").sortWithinPartitions("at", F.col("id") != F.col("at"))
    near = store.put(stars.mapInArrow(_verified(threshold, percent), "a binary, b binary"))
    in_clusters = fetched.where("whole").select(F.col("at").alias("cluster"), "lid", "line")
    # blocks of many rows or long ones
    m = F.greatest(F.count("*"), F.ceil(F.sum(F.octet_length("line")) * F.lit(PER_BLOCK) / F.lit(BLOCK_BYTES)))
    sized = in_clusters.join(in_clusters.groupBy("cluster").agg(m.alias("m")), "cluster")
    alike = group_links(store, sized, "cluster", "m", "lid", PER_BLOCK, lambda t: like_pairs([code_points(s) for s in t.column("line").to_pylist()], threshold, percent))
    store.drop(fetched)
    classes = connected_components(store, near.unionByName(alike))
    linked = store.put(classes.select(F.col("node").alias("lid"), "root"))
    return store.put(linked.unionByName(repeated.join(linked.select("lid"), "lid", "left_anti")))


def repeated_lines(docs: DataFrame, threshold: int = 1, min_chars: int = 20, edit_chars: int = 0, percent: int = 100) -> DataFrame:
    """doc_id, dh, drops (line numbers from 0) of the rows that have lines to drop; dh is xxhash64 of the text."""
    store = Store(docs.sparkSession, "lines")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("dh"), text_or_empty().alias("text"))
    places = store.put(rows.mapInArrow(_places(min_chars), "doc_id long, dh long, line_no int, lid binary"))
    classes = line_classes(store, rows, places, threshold, max(edit_chars, min_chars), percent)
    met = store.put(keep_possible(store, places, classes, "lid").join(classes, "lid").drop("lid"))
    first = met.groupBy("root").agg(F.min(F.struct("doc_id", "dh", "line_no")).alias("first"))
    later = met.join(first, "root").where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.dh") == F.col("dh")) & (F.col("first.line_no") == F.col("line_no"))))
    return store.put(later.groupBy("doc_id", "dh").agg(F.array_sort(F.collect_set("line_no")).alias("drops")))


def dedup_lines(docs: DataFrame, threshold: int = 1, min_chars: int = 20, edit_chars: int = 0, percent: int = 100) -> DataFrame:
    """docs with the text left after dropping repeated lines, and n_lines, n_dropped, drops.

    A line (between \\n, without white space around it) of min_chars characters or more is dropped if its class,
    all lines linked by an edit distance of threshold or less, has an earlier line: earlier by doc_id (null first),
    then by a hash of the text, then by line number. Shorter lines always stay. Lines of fewer than edit_chars
    characters, and those of no more characters than edits, go only as exact repeats. With a percent below 100 the
    edits allowed are that share of the shorter line's characters, threshold at most. Rows with equal doc_id and text
    count as one document and keep the same lines. A text that loses all its lines becomes empty; null texts stay
    null and have 0 lines. Columns of docs that clash with added names are replaced; an empty table gives an empty
    result.
    """
    added = ["n_lines", "n_dropped", "drops"]
    docs = docs.drop(*added)
    drops = repeated_lines(docs, threshold, min_chars, edit_chars, percent).select(F.col("doc_id").alias("_d"), F.col("dh").alias("_h"), "drops")
    docs, names = plain_names(docs)
    text = names["text"]
    out = docs.withColumn("_t", F.xxhash64(text_or_empty(text))).join(drops, F.col(names["doc_id"]).cast("long").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), "left")
    lines = F.split(text, "\n")
    keep: Column = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drops")), lambda i: F.get(F.col("_lines"), i))
    out = out.withColumn("_lines", lines).withColumn(text, F.when(F.col("drops").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n")))
    n_lines = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines"))
    return out.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size("drops"), F.lit(0)).cast("long"), "drops": F.coalesce("drops", F.array().cast("array<int>"))}).select(*own_names(names), *added)
