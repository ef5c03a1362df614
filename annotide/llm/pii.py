"""Personal data by patterns and bootstrapped contextual extraction.

Base rules find emails, IP addresses, card and phone numbers; they and long hexadecimal strings, as seeds of secrets,
are the first believed instances in a graph of instances (identifier-like strings) and lexical patterns (what stands
around them). In rounds, a pattern is worth the share of its instances that are believed, and an instance what its
patterns make of it; instances believed in one round are seeds of further patterns in the next. Patterns of high
confidence discover identifiers that no base rule matches. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotide.llm._common import Store, text_or_empty
from annotide.llm.quality_rules import let

KINDS = ("email", "ip", "card", "phone")
#: Kinds that patterns may add; a secret has no base rule, and is only ever found by the patterns around it.
FOUND = (*KINDS, "secret")

#: Regular expressions of the base kinds, written so that no start is tried within a run that already failed and no
#: match backtracks deeply; a card's candidates are runs of digits and separators, cut up where two separators meet.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGIT_RUN = r"[0-9][0-9\x20-]{14,}[0-9]"
DOUBLE = r"[\x20-](?=[\x20-])"
CARD = r"[0-9][0-9\x20-]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Identifier-like strings: digit groups as of a phone or card number that no token goes on from, or a token of five
#: characters or more with a digit or an at sign.
LIKE = r"(?<![A-Za-z0-9])[(+]?[0-9][0-9()\x20.-]{5,}[0-9](?![A-Za-z0-9_%+@])|(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9._%+@-]{5,}"

SPAN = "array<struct<s:int,e:int,t:string>>"
RUN = 64


def spans(text: Column, regex: str, offset: Column | int = 0) -> Column:
    """Start, end (code points) and text of every match: the parts between matches give their places."""

    def folded(matches: Column, parts: Column, first: Column, last: Column, at: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            s = a["at"] + F.char_length(F.get(parts, i))
            m = F.get(matches, i)
            e = s + F.char_length(m)
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct((s + offset).alias("s"), (e + offset).alias("e"), m.alias("t")))).alias("out"))

        return F.aggregate(F.sequence(first, last), F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])

    def placed(matches: Column, parts: Column) -> Column:
        # a fold that appends copies what it has, so it runs over RUN matches at a time, from where each run begins
        n = F.size(matches)
        length = lambda i: F.char_length(F.get(parts, i)) + F.char_length(F.get(matches, i))
        runs = F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int"))
        sizes = F.transform(runs, lambda r: F.aggregate(F.sequence(r * RUN, F.least((r + 1) * RUN, n) - 1), F.lit(0), lambda a, i: a + length(i)))
        begins = let(sizes, lambda z: F.aggregate(z, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
        whole = let(begins, lambda at: F.flatten(F.transform(runs, lambda r: folded(matches, parts, r * RUN, F.least((r + 1) * RUN, n) - 1, F.get(at, r)))))
        return F.when(n == 0, F.array().cast(SPAN)).when(n <= RUN, folded(matches, parts, F.lit(0), n - 1, F.lit(0))).otherwise(whole)

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: let(F.split(text, regex, -1), lambda p: placed(m, p)))


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def is_ip(t: Column) -> Column:
    return F.forall(F.split(t, r"\."), lambda p: p.cast("double") <= 255)


def is_card(t: Column) -> Column:
    return let(digits_of(t), lambda d: F.when(F.char_length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


def is_phone(t: Column) -> Column:
    return F.char_length(digits_of(t)).between(8, 15)


def _gated(gate: Column, found: Column) -> Column:
    return F.when(gate, found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; a text without the characters that a kind needs is not searched for it."""
    digit = text.rlike("[0-9]")
    runs = _gated(text.rlike(DIGIT_RUN), spans(text, DIGIT_RUN))
    cards = F.flatten(F.transform(runs, lambda r: spans(F.regexp_replace(r["t"], DOUBLE, "x"), CARD, r["s"])))
    return {
        "email": _gated(text.contains("@"), spans(text, EMAIL)),
        "ip": _gated(digit & text.contains("."), F.filter(spans(text, IP), lambda x: is_ip(x["t"]))),
        "card": F.filter(cards, lambda x: is_card(x["t"])),
        "phone": _gated(digit & text.contains("+"), F.filter(spans(text, PHONE), lambda x: is_phone(x["t"]))),
    }


def mentions(text: Column) -> Column:
    """Identifier-like strings with the two words before and the word after them, and the word and marks right before."""
    found = _gated(text.rlike("[0-9@]"), spans(text, LIKE))

    def context(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(x["s"] - 63, F.lit(1)), F.least(x["s"], F.lit(64))))
        after = F.lower(F.substring(text, x["e"] + 1, F.lit(48)))
        two = F.regexp_extract(before, r"([\p{L}:=]+)[^\p{L}:=\n]+([\p{L}:=]+)[^\p{L}:=\n]*$", 0)
        one = F.regexp_extract(before, r"([\p{L}:=]+)[^\p{L}:=\n]*$", 1)
        behind = F.regexp_extract(after, r"^[^\p{L}\n]*(\p{L}+)", 1)
        mark = F.regexp_extract(before, r"\p{L}+\s?[^\p{L}\s]\s?[^\p{L}\s]?$", 0)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["t"]).alias("t"), two.alias("two"), one.alias("one"), behind.alias("behind"), mark.alias("mark"))

    return F.transform(found, context)


def seed_of_secret(t: Column) -> Column:
    """Hexadecimal strings of 32 characters or more, in lower case, with a digit and a letter."""
    return t.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$")


def fits(kind: Column, t: Column) -> Column:
    """Whether a string can be an instance of the kind by its form, which is wider than the base rule's."""
    n = F.char_length(digits_of(t))
    bare = t.rlike(r"^[0-9()+\x20.-]+$")
    return (
        F.when(kind == "email", t.contains("@"))
        .when(kind == "ip", t.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$"))
        .when(kind == "card", bare & n.between(13, 19))
        .when(kind == "phone", bare & n.between(7, 15))
        .otherwise((F.char_length(t) >= 16) & t.rlike("[0-9]") & t.rlike("[a-z]") & ~t.contains("@"))
    )


def _patterns(m: DataFrame) -> DataFrame:
    """Mentions by pattern: the two words before, one on each side, or a word before with the marks that follow it."""
    two = F.struct(F.concat(F.lit("<"), F.regexp_replace("two", r"[^\p{L}:=]+", " ")).alias("pattern"), (F.col("two") != "").alias("ok"))
    sides = F.struct(F.concat_ws(" ", F.lit("<>"), "one", "behind").alias("pattern"), ((F.col("one") != "") & (F.col("behind") != "")).alias("ok"))
    mark = F.struct(F.concat(F.lit("|"), F.regexp_replace("mark", r"\s", "")).alias("pattern"), (F.col("mark") != "").alias("ok"))
    return m.withColumn("p", F.explode(F.array(two, sides, mark))).where("p.ok").withColumn("pattern", F.col("p.pattern")).drop("p")


def learn_patterns(store: Store, graph: DataFrame, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """kind, pattern, confidence of the patterns that are trusted after some rounds.

    graph: pattern, inst (its text's hash), kind (of an instance that is a seed, or null), may (the kinds that its form
    allows), one row for each different pattern and instance. Seeds have a belief of 1. In each round the confidence
    of a pattern in a kind is the sum of the beliefs in its instances over their number; it is trusted from
    min_confidence on if min_seeds of them are seeds or believed as much. The belief in an instance that is no seed is
    1 - product of (1 - confidence) over the trusted patterns where it stands, for kinds that its form allows.
    """
    sizes = store.put(graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds))
    graph = store.put(graph.join(sizes, "pattern"))  # patterns of fewer instances can't be trusted in any round
    edges = graph.where("kind is null").select("pattern", "inst", "may")
    seeds = store.put(graph.where("kind is not null").select("kind", "inst").distinct().withColumn("belief", F.lit(1.0)))
    beliefs, state = seeds, None
    for _ in range(rounds):
        sums = graph.select("pattern", "inst", "n").join(beliefs, "inst").groupBy("kind", "pattern").agg(F.sum("belief").alias("got"), F.count_if(F.col("belief") >= min_confidence).alias("sure"), F.max("n").alias("n"))
        new = sums.withColumn("confidence", F.col("got") / F.col("n")).where((F.col("sure") >= min_seeds) & (F.col("confidence") >= min_confidence))
        new = store.put(new.select("kind", "pattern", "confidence"))
        found = edges.join(new, "pattern").where(F.array_contains("may", F.col("kind"))).groupBy("kind", "inst").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("belief"))
        believed = store.put(seeds.unionByName(found))
        store.drop(*(t for t in (state, beliefs if beliefs is not seeds else None) if t is not None))
        state, beliefs = new, believed
    return state


def _joined(spans_by_kind: Column) -> Column:
    """kind:start:end of (number of kind, s, e) structs in order, comma-joined."""
    names = F.array(*(F.lit(k) for k in FOUND))
    return F.array_join(F.transform(F.array_sort(spans_by_kind), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, rounds: int = 3, min_seeds: int = 5, min_confidence: float = 0.8) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_spans and n_found for every row.

    spans holds the base spans and those that learned patterns add: identifier-like strings of the kind's form, in a
    pattern that is trusted (see learn_patterns), that overlap no base span; of several kinds the most confident, then
    the first listed. n_spans counts them all, n_found the added ones. Null texts are empty ones. Rows with equal
    doc_id and text get equal results and come out each; other columns are ignored; an empty table gives an empty
    result.
    """
    store = Store(docs.sparkSession, "pii")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = rows.select("doc_id", F.xxhash64("text").alias("dh"), *(c.alias(k) for k, c in base_spans(F.col("text")).items()), mentions(F.col("text")).alias("like"))

    def numbered(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    known = F.flatten(F.array(*(numbered(i) for i in range(len(KINDS)))))
    found = found.select("doc_id", "dh", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), known.alias("base"), "like")
    found = store.put(found)

    kinds = F.array(*(F.lit(k) for k in FOUND))
    m = found.where(F.size("like") > 0).select("doc_id", "dh", "base", F.explode("like").alias("m")).select("doc_id", "dh", "base", "m.*")
    m = m.withColumn("inside", F.filter("base", lambda b: (b["s"] < F.col("e")) & (b["e"] > F.col("s"))))
    m = m.withColumn("based", F.get(kinds, F.get("inside", F.lit(0))["k"]))
    kind = F.coalesce("based", F.when(seed_of_secret(F.col("t")), F.lit("secret")))
    m = m.select("doc_id", "dh", "s", "e", "t", F.xxhash64("t").alias("inst"), "two", "one", "behind", "mark", "based", kind.alias("kind"))
    m = _patterns(m)
    may = F.filter(kinds, lambda k: fits(k, F.col("t")))
    graph = m.groupBy("pattern", "inst").agg(F.max("kind").alias("kind"), F.first("t").alias("t")).select("pattern", "inst", "kind", may.alias("may"))
    trusted = store.put(learn_patterns(store, store.put(graph), rounds, min_seeds, min_confidence).withColumnRenamed("kind", "of_kind"))

    number = F.array_position(kinds, F.col("of_kind")).cast("int") - 1
    new = m.where("based is null").drop("kind", "based").join(trusted, "pattern").where(fits(F.col("of_kind"), F.col("t")))
    new = new.groupBy("doc_id", "dh", "s", "e").agg(F.max(F.struct("confidence", (-number).alias("minus"))).alias("best"))
    new = new.groupBy("doc_id", "dh").agg(F.collect_set(F.struct((-F.col("best.minus")).cast("int").alias("k"), "s", "e")).alias("more"))
    new = store.put(new).select(F.col("doc_id").alias("d"), F.col("dh").alias("h"), "more")
    out = found.join(new, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("dh") == F.col("h")), "left")
    more = F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>"))
    n_found = F.size(more).cast("long")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", more)).alias("spans"), (F.size("base") + n_found).cast("long").alias("n_spans"), n_found.alias("n_found"))
