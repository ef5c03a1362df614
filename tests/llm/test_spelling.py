"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from annotide.llm import queries, spelling
from tests.llm.data import empty, hard_rows, table
from tests.oracle import connection, difference


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts: dict[str, int], ratio: int = 10) -> list[tuple]:
    form, n_near = {}, {}
    for w in counts:
        others = sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x))
        n_near[w] = len(others)
        if others and counts[others[0]] >= ratio * counts[w]:
            form[w] = others[0]
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], n_near[w], counts[form[w]] if w in form else None))
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_counts_of_hard_rows(spark):
    want = Counter()
    for d, t, *_ in hard_rows():
        for r in re.findall("[A-Za-zÀ-ÿ]{7,}", t or ""):
            want["".join(c.lower() if c < "[" else c for c in r)] += 1
    runs = spelling.corpus_runs(table(spark))
    from pyspark.sql import functions as F

    assert dict(spelling.count_words(runs, F.col("run"), min_n=1).collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    """Words over few letters, so that bigrams repeat in a word and tie in frequency; variants of variants, chains of forms."""
    rnd = random.Random(seed)
    counts = {}
    for _ in range(250):
        w = "".join(rnd.choice("abéÿ" if seed == 1 else "abcdefghijklm") for _ in range(rnd.randint(7, 10)))
        counts[w] = rnd.choice([2, 3, 20, 200, 2000, 20000])
        for _ in range(rnd.randint(0, 4)):
            i, c = rnd.randrange(len(w) + 1), rnd.choice("abéz")
            w = rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            if len(w) >= 7:
                counts[w] = rnd.choice([2, 2, 30, 300])
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.group_variants(df)) == plain(counts)


def test_long_words_ties_and_chains(spark):
    long = "xy" * 3000
    counts = {long: 2, long + "z": 100, long[:4000] + "q" + long[4001:]: 100, "aaaaaaa": 2, "aaaaaaaa": 3, "aaaaaaaaa": 50, "baaaaaaaa": 50, "baaaaaaab": 5000, "zaaaaaaab": 60000}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.group_variants(df)) == plain(counts)


def test_a_hot_bigram_keeps_all_pairs(spark):
    """A third of the words begin alike and differ in one letter from a common one."""
    rnd = random.Random(5)
    base = "qzabcdefgh"
    counts = {base: 40000}
    for i in range(2, 10):
        for c in "ijklmnopqrstuvwxyz":
            counts[base[:i] + c + base[i + 1 :]] = 2
    for _ in range(300):
        counts["".join(rnd.choice("abcdefghijklmnop") for _ in range(9))] = 4
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.group_variants(df)) == plain(counts)


def test_empty(spark):
    from pyspark.sql import functions as F

    assert got(spelling.group_variants(spelling.count_words(spelling.corpus_runs(empty(spark)), F.col("run")))) == []


def test_query(spark, sf_dir):
    assert difference(queries.op11_spelling_variants(spark, sf_dir), connection(sf_dir), queries.OP11_SQL) == ""


def test_query_of_hard_rows(spark, tmp_path):
    rows = [*hard_rows(), (None, "überall gleiches gleiches", "de", "c", 5), (16, "Überall gleiches x" + "y" * 9000, None, None, 1), (17, "x" + "y" * 9000 + " gleichez", "de", "c", 2)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for d, t, *_ in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c < "[" else c for c in r)
            h = zlib.crc32(f"{'' if d is None else f'{d}:'}{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            counts[r] += 1
    assert got(queries.op11_spelling_variants(spark, str(tmp_path))) == plain({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
