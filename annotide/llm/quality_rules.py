"""Quality rules with adaptive thresholds.

Fixed base rules reject texts that are short or repeat themselves. For the rest, no cutoff is fixed: per language and
source, mergeable quantile sketches of a few rates give a fence (third quartile plus a multiple of the quartile
distance), and a join with the fences filters the rows. A sketch counts rates on a fixed grid, whose steps grow with the
rate, so it is the same in every run, however its parts are merged. The sketches of a cell's language and of the
whole corpus enter each cell's with the weight of a few rows: they decide where it has next to none, and fade as it grows.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.llm._common import Store, own_names, plain_names, text_or_empty

#: Word separators of the contract: space and the ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rate -> smallest quartile distance that counts (rates of clean text are often constant).
RATES = {"symbol_rate": 0.02, "caps_rate": 0.02, "bang_rate": 0.02, "word_length": 1.0}

#: Units of a rate in the sketches' grid.
GRID = 4096


def n_removed(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once and bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_windows(words: Column, width: int = 8) -> Column:
    """Words that stand in a window of width words found twice or more in the text, the first one included."""

    def covered(keyed: Column) -> Column:
        again = F.filter(keyed, lambda x, i: (F.get(keyed, i - 1)["h"] == x["h"]) | F.coalesce(F.get(keyed, i + 1)["h"] == x["h"], F.lit(False)))
        return F.aggregate(
            F.array_sort(F.transform(again, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at")),
            lambda a, s: F.struct((a["n"] + F.least(F.lit(width), s - a["at"])).alias("n"), s.alias("at")),
            lambda a: a["n"],
        )

    def counted(hashes: Column) -> Column:
        # a text whose windows all differ needs no more than the distinct count
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(keyed, covered))

    def of_words(w: Column) -> Column:
        # window hashes from the hashes of the words: eight numbers to hash instead of eight strings
        word_hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(word_hashes, lambda h: let(F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width))), counted))

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(words, of_words))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rates."""
    out = docs.withColumn("_t", text_or_empty(text)).withColumn("_words", words_of(F.col("_t"))).withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    out = out.withColumns(
        {
            "word_chars": F.char_length(F.translate(F.col("_t"), BLANKS, "")).cast("long"),
            "n_symbols": n_removed(F.col("_t"), SYMBOLS).cast("long"),
            "_caps": n_removed(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_bangs": n_removed(F.col("_t"), "!"),
        }
    )
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    out = out.withColumns({"symbol_rate": F.try_divide(F.col("n_symbols"), n), "caps_rate": F.try_divide(F.col("_caps"), chars), "bang_rate": F.try_divide(F.col("_bangs"), n), "word_length": F.try_divide(chars, n)})
    out = out.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return out.withColumn("n_repeat_words", repeated_windows(F.col("_words")).cast("long"))


def grid_step(rate: Column) -> Column:
    """The rate in units of 1 / GRID, rounded down to 7 binary digits: the lower edge of its bin."""
    units = F.floor(rate * GRID).cast("long")
    return let(units, lambda q: F.call_function("shiftleft", F.call_function("shiftright", q, _surplus(q)), _surplus(q)))


def _surplus(q: Column) -> Column:
    return F.greatest(F.char_length(F.bin(q)) - 7, F.lit(0))


def sketches(rows: DataFrame) -> DataFrame:
    """f_lang, f_source, rate, bin, n: the sketch of each rate in each cell (language, source); null languages and sources are
    cells of their own. A cell has some 1,000 bins at most, at any number of rows."""
    told = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), grid_step(F.col(r)).alias("bin")) for r in RATES))).alias("x")
    return rows.select(F.col("_lang").alias("f_lang"), F.col("_source").alias("f_source"), told).groupBy("f_lang", "f_source", "x.rate", "x.bin").agg(F.count("*").alias("n"))


def fences(cells: DataFrame, of_lang: int, of_all: int, reach: float) -> DataFrame:
    """f_lang, f_source and an upper fence for each rate, from the sketches of all cells.

    To a cell's counts come the shares of its language's and of all rows, as if of_lang and of_all more rows were theirs.
    """

    def share(n: str, total: str, rows: int) -> Column:
        return F.round(F.lit(float(rows)) * F.col(n) / F.col(total), 6).cast("decimal(28,6)").alias("w")

    whole = cells.groupBy("rate", "bin").agg(F.sum("n").alias("n"))
    whole = whole.join(cells.groupBy("rate").agg(F.sum("n").alias("total")), "rate").select("rate", "bin", share("n", "total", of_all))
    lang = cells.groupBy(F.col("f_lang").alias("l_lang"), "rate", "bin").agg(F.sum("n").alias("n"))
    by_lang = cells.groupBy(F.col("f_lang").alias("t_lang"), F.col("rate").alias("t_rate")).agg(F.sum("n").alias("total"))
    lang = lang.join(by_lang, F.col("l_lang").eqNullSafe(F.col("t_lang")) & (F.col("rate") == F.col("t_rate"))).select("l_lang", F.col("rate").alias("l_rate"), "bin", share("n", "total", of_lang))
    each = cells.select("f_lang", "f_source", "rate").distinct()
    parts = cells.select("f_lang", "f_source", "rate", "bin", F.col("n").cast("decimal(28,6)").alias("w"))
    parts = parts.unionByName(each.join(lang, F.col("f_lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate"))).select("f_lang", "f_source", "rate", "bin", "w"))
    parts = parts.unionByName(each.join(whole, "rate").select("f_lang", "f_source", "rate", "bin", "w"))
    bins = parts.groupBy("f_lang", "f_source", "rate", "bin").agg(F.sum("w").alias("w"))
    cell = Window.partitionBy("f_lang", "f_source", "rate")
    below = bins.withColumns({"upto": F.sum("w").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(cell)})
    low, high = (F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bin"))) / F.lit(float(GRID)) for k in (1, 3))
    quartiles = below.groupBy("f_lang", "f_source", "rate").agg(low.alias("q1"), high.alias("q3"))
    least = F.coalesce(*(F.when(F.col("rate") == r, F.lit(v)) for r, v in RATES.items()))
    fence = quartiles.withColumn("fence", F.col("q3") + F.lit(reach) * F.greatest(F.col("q3") - F.col("q1"), least))
    return fence.groupBy("f_lang", "f_source").agg(*(F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"max_{r}") for r in RATES))


def judge(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, of_lang: int = 150, of_all: int = 50, reach: float = 6.0, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns carry) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in repeated 8-word
    windows. kept: not base_failed, and no rate above its fence; a text equal to the fence stays. Null or empty
    texts have no words and fail. Rows are judged each, so repeated rows stay repeated; null languages and
    sources are joined as values of their own; columns of docs that clash with added names are replaced. Texts are
    read once: the rows are written with their features, from which the sketches are taken.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = docs.drop(*added)
    store = Store(docs.sparkSession, "quality")
    docs, names = plain_names(docs)
    lang, source = F.col(names["lang"]), F.col(names["source"])
    rows = with_features(docs, names["text"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    if carry is not None:
        names = {c: n for c, n in names.items() if c in carry}
    rows = rows.select(*names.values(), *added[:5], failed.alias("base_failed"), lang.alias("_lang"), source.alias("_source"), *RATES)
    rows = store.put(rows)
    cells = store.put(sketches(rows.where(F.col("n_words") >= min_words)))
    cut = store.put(fences(cells, of_lang, of_all, reach))  # read back with its true size
    out = rows.join(cut, F.col("_lang").eqNullSafe(F.col("f_lang")) & F.col("_source").eqNullSafe(F.col("f_source")), "left")
    inside = F.lit(True)
    for r in RATES:
        inside = inside & (F.col(r) <= F.col(f"max_{r}"))
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))).select(*own_names(names), *added)
