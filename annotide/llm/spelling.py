"""Spelling variants of the words of a corpus: a self join on the rarest positional bigrams of each word.

One inserted, deleted or replaced letter destroys at most two bigrams of a word, so of its three rarest, in an order
of all bigrams by frequency, one is also among the three rarest of any word that differs by one letter, at the same
place or the next. Words meet there and nowhere else; edit distances decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotide.llm._common import Store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of words after lower-casing: a to z, then the 64 from U+00C0 on. Pairs of them are all the bigrams there are.
N_LETTERS = 26 + 64
PREFIX = 3


def corpus_runs(docs: DataFrame, least: int = 7) -> DataFrame:
    """doc_id and run of every maximal run of least or more letters (A to Z, a to z, U+00C0 to U+00FF), A to Z lower-cased.
    Null and empty texts have none; repeated rows count each."""
    run = F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0)))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    return docs.select(F.col("doc_id"), run.alias("run")).select("doc_id", low.alias("run"))


def drop_letter(word: Column, at: Column) -> Column:
    """The word without its code point number at, from 0."""
    at = at.cast("int")
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def count_words(runs: DataFrame, word: Column, least: int = 7, min_n: int = 2) -> DataFrame:
    """word, n of the words of at least `least` code points that occur at least min_n times."""
    return runs.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def _grams(word: Column) -> Column:
    """The number of each bigram of a word, in order."""
    code = F.transform(F.split(word, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26))
    return F.transform(F.arrays_zip(F.slice(code, 1, F.size(code) - 1).alias("a"), F.slice(code, 2, F.size(code) - 1).alias("b")), lambda x: x["a"] * N_LETTERS + x["b"])


def gram_ranks(words: DataFrame) -> Column:
    """Array literal of the rank by frequency of every bigram, the rarest first; as long as there are pairs of letters."""
    seen = words.select(F.explode(_grams(F.col("word"))).alias("g")).groupBy("g").count().collect()  # at most N_LETTERS ** 2 rows
    counts = {r["g"]: r["count"] for r in seen}
    order = sorted(range(N_LETTERS**2), key=lambda g: (counts.get(g, 0), g))
    rank = [0] * len(order)
    for i, g in enumerate(order):
        rank[g] = i
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<int>")  # folded to one constant


def _parts(p: Column, length: Column) -> Column:
    """Number, begin and end of three parts of a word of some length around its bigram at p: what stands before it and
    after it, the longer of them (of equal ones the first) in two."""
    after = length - 2 - p
    half = F.floor(p / 2).cast("int")
    mid = p + 2 + F.floor(after / 2).cast("int")
    part = lambda i, a, b: F.struct(F.lit(i).alias("i"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    zero = F.lit(0)
    return F.when(p >= after, F.array(part(0, zero, half), part(1, half, p), part(2, p + 2, length))).otherwise(F.array(part(0, zero, p), part(1, p + 2, mid), part(2, mid, length)))


def _letters(part: Column) -> Column:
    """Bits of the letters in a part of a word."""
    return F.aggregate(F.filter(F.split(part, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def _keys(rare: DataFrame, p: Column, length: Column, extra: int, where: Column) -> DataFrame:
    """rare with key, the hash of a word but for one of its parts, and sig, the letters of that part: as it is
    (extra 0), or as of a word shorter by one letter (1) in that part, whose bigram is at p."""
    rows = rare.withColumns({"p": p, "short": length}).where((F.col("p") >= 0) & (F.col("p") + 2 <= F.col("short")))
    rows = rows.select("word", "n", "p", "short", F.explode(_parts(F.col("p"), F.col("short"))).alias("k")).where(where)
    end = F.col("k.b") + extra
    rest = F.concat(F.substring("word", F.lit(1), F.col("k.a")), F.substring("word", end + 1, F.char_length("word")))
    key = F.xxhash64("p", "short", "k.i", rest)
    return rows.select("word", "n", key.alias("key"), _letters(F.substring("word", F.col("k.a") + 1, end - F.col("k.a"))).alias("sig"), F.lit(bool(extra)).alias("longer"))


def near_words(words: DataFrame, ranks: Column) -> DataFrame:
    """a, a_n, b, b_n: every pair of words (once) that differ by exactly one inserted, deleted or replaced code point.

    Words that share a bigram differ in one of the three parts around it and agree in the other two, so they meet by
    the place of the bigram, the length and what they have besides that part; letters in the part that only one of
    them has are counted before edit distances.
    """
    ranked = F.transform(_grams(F.col("word")), lambda g, i: F.struct(F.get(ranks, g).alias("g"), i.alias("p")))
    rare = words.select("word", "n", F.char_length("word").alias("len"), F.explode(F.slice(F.array_sort(ranked), 1, PREFIX)["p"]).alias("at"))
    always = F.lit(True)
    same = _keys(rare, F.col("at"), F.col("len"), 0, always)
    # a letter more stands behind the bigram, which is then at its place, or before it, which is then one further on
    behind = _keys(rare, F.col("at"), F.col("len") - 1, 1, F.col("k.a") >= F.col("p") + 2)
    before = _keys(rare, F.col("at") - 1, F.col("len") - 1, 1, F.col("k.b") <= F.col("p"))
    left = same.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key", F.col("sig").alias("a_sig"))
    right = same.unionByName(behind).unionByName(before).withColumnsRenamed({"word": "b", "n": "b_n"})
    met = left.join(right, "key").where((F.bit_count(F.col("a_sig").bitwiseXOR(F.col("sig"))) <= 2) & (F.col("longer") | (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a table of different words with their counts n.

    n_near counts the words that are one code point away. form is the most frequent of these (of equal ones the first
    in code-point order) if it occurs at least ratio times as often, with its count form_n, else null; root is where
    following forms ends, the word itself without one. An empty table gives an empty result.
    """
    store = Store(words.sparkSession, "spelling")
    words = store.put(words.select("word", "n"))
    most = words.agg(F.max("n")).first()[0]
    pairs = store.put(near_words(words, gram_ranks(words)))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    out = words.join(best, "word", "left")
    taken = -F.col("best.minus") >= ratio * F.col("n")
    out = store.put(out.select("word", F.when(taken, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, -F.col("best.minus")).alias("form_n")))
    store.drop(pairs, words)
    # each form is ratio times as frequent, so a chain has fewer than log(most) links, which doubling follows
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(math.log(max(most or 1, 1), ratio), 1))) if ratio > 1 else 0):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = store.put(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
