"""Small tables of hard cases."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside or add.
CLASHING = ("g", "b", "n", "m", "key", "lo", "hi", "own", "size", "shard", "slot", "ids", "tid", "rep", "bands", "sig", "lid", "line", "line_no", "drops", "n_lines", "kept", "base_failed", "n_words", "rate", "n_copies", "copy_no", "_u", "_cdf", "_t", "_words", "f_lang", "spans", "base", "like", "bucket", "ahead", "chunk", "cuts", "k1", "k2", "n_tokens", "score", "lang_pred", "class_id", "n_links", "_stays", "_tid", "_d", "part", "offset", "fingerprint", "at", "h", "dh")


def long_text() -> str:
    return "\n".join(f"This is line number {i} of a very long text, which says {i * 7919 % 1000} and {i * i % 997} in {i * 31 % 89} words." for i in range(3000))


def hard_rows() -> list[tuple]:
    base = "The quick brown fox jumps over the lazy dog while twenty other animals look at it from the far side of the old garden wall"
    return [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base.replace("twenty", "thirty"), "en", "b", len(base)),
        (4, None, "en", "a", None),
        (5, "", None, "a", 0),
        (6, " \n\t ", "de", None, 4),
        (7, "word", None, None, 4),
        (8, "1234 5678 !!", "en", "b", 12),
        (9, long_text(), "en", "a", len(long_text())),
        (10, base + "\n" + base + "\n" + base.replace("quick", "quack"), "en", "b", 3 * len(base) + 2),
        (10, base + "\n" + base + "\n" + base.replace("quick", "quack"), "en", "b", 3 * len(base) + 2),
        (None, "Ein Text ohne Nummer, aber mit genug Wörtern und Zeichen für alles.", "de", "c", 67),
        (12, "x" * 5000, "fr", "c", 5000),
        (13, "é́ \U0001f600 ﬁ   \x00 <|endoftext|> <|startoftext|>the end of it", "fr", "c", 40),
        (14, "mail a@b.co, call +49 (30) 123-4567, host 10.0.0.1 or 300.1.1.1, card 4111 1111 1111 1111", "en", "b", 90),
        (15, "word", "en", "a", 4),
    ]


def table(spark, rows=None, extra: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
