"""Groups of any size as bounded tasks: blocks of a group's members, and pairs of blocks dealt to partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotide.llm._common import Store, connected_components

#: Whether the rows x[i] and y[i] of a table are linked.
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]
PORTION_BYTES = 1 << 22


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First item and end of spans of items whose sizes add up to most or less, or of one larger item."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        z = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")), at + 1)
        yield at, z
        at = z


def block_pairs(rows: DataFrame, group: str, size: Column, member: str, per_block: int) -> DataFrame:
    """rows with lo, hi and own, dealt by (group, lo, hi) and sorted by them within partitions.

    The members of a group fall by hash into blocks of about per_block; every pair of blocks is one small group, so a
    member is repeated once for each block and any two members meet in exactly one place: where lo = hi, any two rows
    do, elsewhere rows of own = lo meet rows of own = hi.
    """
    blocks = F.ceil(size / F.lit(per_block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.col(group)), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other")).drop("_other")
    return rows.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups of rows sorted by keys, with the offsets of the groups (the last is the end). But for the
    last group, tables hold about least_rows rows or PORTION_BYTES, however long the rows of a batch are."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            if isinstance(c, pa.ChunkedArray):
                c = pa.concat_arrays(c.chunks)
            change[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
        return np.append(np.nonzero(change)[0], t.num_rows)

    def portions() -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(b.num_rows * PORTION_BYTES // max(b.nbytes, 1), 1)
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)

    rows = size = 0
    for b in portions():
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows >= least_rows or size >= PORTION_BYTES:
            t = pa.Table.from_batches(held)
            at = cut(t)
            if len(at) > 2:
                yield t.slice(0, at[-2]), at[:-1]
                held = t.slice(at[-2]).to_batches()
                rows, size = sum(h.num_rows for h in held), sum(h.nbytes for h in held)
    if rows:
        t = pa.Table.from_batches(held)
        yield t, cut(t)


@lru_cache(maxsize=64)
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def triangle(n: int, firsts: int, at_most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs x < y of n rows with x among the first ones, in portions of at_most pairs or those of one row."""
    per_row = n - 1 - np.arange(min(firsts, n))
    for a, z in spans(per_row, at_most):
        n_y = per_row[a:z]
        x = np.repeat(np.arange(a, z), n_y)
        yield x, np.arange(1, len(x) + 1) + x - np.repeat(np.cumsum(n_y) - n_y, n_y)


def pairs_of(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, at_most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs that meet, in portions of about at_most pairs."""
    firsts, seconds, n = [], [], 0
    sizes = np.diff(at)
    two = at[:-1][sizes == 2]
    two = two[(lo[two] == hi[two]) | (own[two] != own[two + 1])]
    for k in range(0, len(two), at_most):
        yield two[k : k + at_most], two[k : k + at_most] + 1

    def of_group(a: int, z: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if lo[a] == hi[a]:
            for x, y in [_all_pairs(int(z - a))] if z - a <= 64 else triangle(z - a, z - a, at_most):
                yield x + a, y + a
            return
        left, right = a + np.nonzero(own[a:z] == lo[a])[0], a + np.nonzero(own[a:z] == hi[a])[0]
        for i, k in spans(np.full(len(left), len(right)), at_most):
            yield np.repeat(left[i:k], len(right)), np.tile(right, k - i)

    for g in np.nonzero(sizes > 2)[0]:
        for x, y in of_group(at[g], at[g + 1]):
            firsts.append(x)
            seconds.append(y)
            n += len(x)
            if n >= at_most:
                yield np.concatenate(firsts), np.concatenate(seconds)
                firsts, seconds, n = [], [], 0
    if n:
        yield np.concatenate(firsts), np.concatenate(seconds)


def least_labels(n: int, x: np.ndarray, y: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least row number that each of n rows reaches over the links x - y."""
    label = np.arange(n) if label is None else label
    while len(x):
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def bounded_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int, least_rows: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Tables of complete groups of rows sorted by a long key, with their offsets; a group of more than limit rows may
    come in portions instead, each without offsets, so that no group of any size is held."""
    held: pa.Table | None = None
    streamed: int | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if streamed is not None:
            other = np.nonzero(t.column(key).to_numpy() != streamed)[0]
            n = int(other[0]) if len(other) else t.num_rows
            if n:
                yield t.slice(0, n), None
            if n == t.num_rows:
                continue
            t, streamed = t.slice(n), None
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < least_rows:
            continue
        keys = held.column(key).to_numpy()
        at = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        if len(at) > 2:
            yield held.slice(0, at[-2]), at[:-1]
        held = held.slice(at[-2])
        if held.num_rows > limit:
            yield held, None
            held, streamed = None, int(keys[-1])
    if held is not None and held.num_rows:
        keys = held.column(key).to_numpy()
        yield held, np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])


def links_within(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], test: Test, label: np.ndarray | None = None) -> np.ndarray:
    """Labels of n rows after linking the pairs that pass the test; those already of one label are not tested."""
    label = np.arange(n) if label is None else label
    for x, y in pairs:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if len(x):
            ok = test(x, y)
            label = least_labels(n, x[ok], y[ok], label)
    return label


def with_first(at: np.ndarray, more_than: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within groups; in larger groups the first row meets all others before these meet each other."""
    zero = np.zeros(at[-1], np.int32)
    sizes = np.diff(at)
    for a, z in zip(at[:-1][sizes > more_than], at[1:][sizes > more_than]):
        yield np.full(z - a - 1, a), np.arange(a + 1, z)
    yield from pairs_of(at, zero, zero, zero)


def _moved(member: pa.ChunkedArray, label: np.ndarray) -> pa.RecordBatch:
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return pa.RecordBatch.from_arrays([member.take(pa.array(moved)).combine_chunks(), member.take(pa.array(label[moved])).combine_chunks()], ["a", "b"])


def group_links(store: Store, rows: DataFrame, group: str, size: str, member: str, per_block: int, test_of: Callable[[pa.Table], Test], largest: int | None = None) -> DataFrame:
    """a, b: links that connect within each group all members which pairs that pass a test connect.

    rows: each member of a group once, with the group's size (that, or more where rows are long). test_of(table) gives the test of row numbers x, y of a
    table of rows; largest is the size of the largest group, where it is known. Members fall by hash into blocks of about per_block, and a group's first member goes to all of its
    blocks: what is like it is linked there, and most pairs need no test. Then only members outside the largest
    component of their group meet the members of other blocks. So each row moves once, and a group of near copies
    costs in proportion to its size; members that nothing links cost all their pairs, as they must.
    """
    kind = rows.schema[member].dataType.simpleString()
    if largest is None:
        largest = rows.agg(F.max(size)).first()[0] or 0
    if largest > per_block:
        rows = store.put(rows)  # read several times
    blocks = F.ceil(F.col(size) / F.lit(per_block)).cast("int")
    many = rows.where(F.col(size) > per_block)
    own = F.pmod(F.xxhash64(F.col(member), F.col(group)), blocks).cast("int")
    if largest <= per_block:
        dealt = rows.withColumn("_block", F.lit(0)).repartition(group).sortWithinPartitions(group)
    else:
        first = many.groupBy(F.col(group).alias("_g")).agg(F.min(member).alias("_first"))
        places = F.when((F.col("_first") == F.col(member)) & (F.col(size) > per_block), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
        dealt = rows.join(first, F.col(group) == F.col("_g"), "left").withColumn("_block", F.explode(places))
        dealt = dealt.withColumn("_rank", F.when(F.col("_first") == F.col(member), 0).otherwise(1)).drop("_g", "_first")
        dealt = dealt.repartition(group, "_block").sortWithinPartitions(group, "_block", "_rank")

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, [group, "_block"]):
            yield _moved(t.column(member), links_within(t.num_rows, with_first(at), test_of(t)))

    links = store.put(dealt.mapInArrow(in_blocks, f"a {kind}, b {kind}"))
    if largest <= per_block:
        return links

    components = connected_components(store, links).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    labelled = many.join(components, F.col(member) == F.col("_node"), "left").withColumn("_comp", F.coalesce("_root", member)).drop("_node", "_root")
    labelled = store.put(labelled)
    per_comp = labelled.groupBy(F.col(group).alias("_g"), "_comp").agg(F.count("*").alias("n"))
    main = per_comp.groupBy("_g").agg(F.max(F.struct("n", "_comp")).alias("most"), F.sum("n").alias("all")).select("_g", F.col("most._comp").alias("_main"), (F.col("all") - F.col("most.n")).alias("_outside"), F.col("all").alias("_all")).where("_outside > 0")
    main = store.put(main)
    if not main.limit(1).count():
        return links
    labelled = labelled.join(main, F.col(group) == F.col("_g")).drop("_g").withColumn("_outer", F.ceil(F.col("_outside") * F.col(size) / F.col("_all") / F.lit(per_block)).cast("int"))
    outside = labelled.where("_comp <> _main").withColumns({"_lo": F.pmod(F.xxhash64(F.lit(1), F.col(member)), F.col("_outer")).cast("int"), "_side": F.lit(0)}).withColumn("_hi", F.explode(F.sequence(F.lit(0), blocks - 1)))
    every = labelled.withColumns({"_hi": own, "_side": F.lit(1)}).withColumn("_lo", F.explode(F.sequence(F.lit(0), F.col("_outer") - 1)))
    grid = outside.unionByName(every).drop("_main", "_outside", "_all", "_outer").repartition(group, "_lo", "_hi").sortWithinPartitions(group, "_lo", "_hi")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, [group, "_lo", "_hi"]):
            side = t.column("_side").to_numpy()
            comp = t.column("_comp").combine_chunks().dictionary_encode().indices.to_numpy()
            zero, one = np.zeros(len(side), np.int32), np.ones(len(side), np.int32)
            pairs = ((x[comp[x] != comp[y]], y[comp[x] != comp[y]]) for x, y in pairs_of(at, zero, one, side))
            yield _moved(t.column(member), links_within(t.num_rows, pairs, test_of(t)))

    return store.put(links.unionByName(grid.mapInArrow(across, f"a {kind}, b {kind}")))
