"""The operators against plain versions, on the smallest test tables and on hard cases."""

from __future__ import annotations

import base64
import hashlib
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from annotide.llm import _blocks, byte_bpe, fingerprints, langid, line_dedup, mixing, ngram_jaccard, pii, quality_rules, sharding, token_counts
from annotide.llm import queries as llm_queries
from annotide.llm._common import documents
from tests.llm import brute
from tests.llm.data import empty, hard_rows, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return documents(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def hard(spark):
    return table(spark).cache()


HARD = [(r[0], r[1]) for r in hard_rows()]


def by_id(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# 1 sharding


def check_shards(got, rows, n_shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, of_text, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        assert 0 <= r.shard < n_shards
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in of_text.values())
    groups = Counter()
    for d, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    loads = [load[i] for i in range(n_shards)]
    assert max(loads) - min(loads) <= max(groups.values())


def test_shards(docs, rows, hard):
    check_shards(sharding.shard_documents(docs, 16).collect(), rows, 16)
    check_shards(sharding.shard_documents(hard, 4, heavy_per_shard=1, rows_per_part=2).collect(), HARD, 4)


def test_lpt_takes_the_least_loaded():
    assert sharding.lpt([(1, 5, 1), (2, 4, 1), (3, 3, 3)], 2) == {1: [1, 0], 2: [0, 1], 3: [1, 2]}
    rng = np.random.default_rng(2)
    for n in (1, 2, 7):
        items = [(k, int(rng.integers(1, 60)), int(rng.integers(1, 40 * n))) for k in range(30)]
        items = [(k, w, m) for k, (w, m) in enumerate({w: m for _, w, m in items}.items())]
        loads, want = [0] * n, defaultdict(lambda: [0] * n)
        for k, w, m in sorted(items, key=lambda x: -x[1]):
            for _ in range(m):
                s = loads.index(min(loads))
                loads[s] += w
                want[k][s] += 1
        assert sharding.lpt(items, n) == want


def test_size_classes(spark):
    got = spark.createDataFrame([(v,) for v in (1, 1023, 1024, 2047, 2049, 5_000_003)], "v long").select("v", sharding.size_class(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in got} == {1: 1, 1023: 1023, 1024: 1024, 2047: 2046, 2049: 2048, 5_000_003: 5_000_003 >> 13 << 13}


# 2 language identification


def greedy_phrases(sample: str, text: str) -> int:
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        if text[i] in sample and i + k < len(text) and text[i + k] not in sample:
            k += 1  # a character that the sample lacks ends the phrase before it
        n, i = n + 1, i + k
    return n


def test_cross_parsing_counts_longest_matches():
    rng = np.random.default_rng(3)
    samples = {"a": "".join(rng.choice(list("abcd "), 300)), "b": "".join(rng.choice(list("abxy "), 300))}
    texts = ["".join(rng.choice(list("abcdxyz "), n)) for n in (1, 7, 50, 200)]
    p = langid.CrossParser(samples)
    norm = lambda t: "".join(map(chr, langid.normalise(t)))
    counts, _ = p.phrases([langid.normalise(t) for t in texts], segment=1000)
    assert counts.tolist() == [[greedy_phrases(norm(samples[k]), norm(t)) for k in ("a", "b")] for t in texts]


@pytest.mark.parametrize("segment, overlap", [(100, 50), (64, 20), (50, 3)])
def test_cross_parsing_in_segments_counts_as_a_whole(segment, overlap):
    rng = np.random.default_rng(4)
    samples = {"a": "".join(rng.choice(list("abcd "), 300)), "b": "".join(rng.choice(list("abxy "), 300))}
    texts = ["".join(rng.choice(list("abcdxyz "), n)) for n in (1, 50, 101, 1000, 5000)] + ["x" * 3000, "ab" * 2000 + "q", "abc " * 300]
    p = langid.CrossParser(samples)
    norm = lambda t: "".join(map(chr, langid.normalise(t)))
    counts, _ = p.phrases([langid.normalise(t) for t in texts], segment, overlap)
    assert counts.tolist() == [[greedy_phrases(norm(samples[k]), norm(t)) for k in ("a", "b")] for t in texts]


def test_cross_parsing_of_a_long_text():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
    samples = {"a": " ".join(rng.choice(words[:250], 300)), "b": " ".join(rng.choice(words[150:], 300))}
    text = " ".join(rng.choice(words, 25_000))
    assert len(text) > 100_000
    counts, _ = langid.CrossParser(samples).phrases([langid.normalise(text)])
    assert counts.tolist() == [[greedy_phrases(samples["a"], text), greedy_phrases(samples["b"], text)]]


def test_scripts_of_thousands_of_letters():
    rng = np.random.default_rng(9)
    letters = [chr(0x4E00 + i) for i in range(4000)]
    some = {k: ["".join(rng.choice(part, 2)) for _ in range(3000)] for k, part in (("x", letters[:2000]), ("y", letters[1000:3000]), ("z", letters[2000:]))}
    p = langid.CrossParser({k: "".join(rng.choice(v, 10_000)) for k, v in some.items()})
    assert p.width > 3500
    texts = [(k, "".join(rng.choice(v, n))) for k, v in some.items() for n in (5, 50, 3000)]
    assert [g[0] for g in p.predict([t for _, t in texts])] == [k for k, _ in texts]


def test_samples_of_unequal_size():
    rng = np.random.default_rng(10)
    stems = {k: ["".join(rng.choice(list(a), rng.integers(2, 8))) for _ in range(600)] for k, a in (("p", "abcdefgh"), ("q", "efghabij"))}
    p = langid.CrossParser({"p": " ".join(rng.choice(stems["p"], 6000)), "q": " ".join(rng.choice(stems["q"], 400))})
    texts = [(k, " ".join(rng.choice(v, 60))) for k, v in stems.items() for _ in range(40)]
    assert sum(g[0] == k for g, (k, _) in zip(p.predict([t for _, t in texts]), texts)) >= 76


def test_ties_go_to_the_first_language():
    p = langid.CrossParser({"b": "one two three", "a": "one two three"})
    assert p.predict(["two one", "zzz", "", None]) == [("a", 0.0), ("a", 0.0), ("und", 0.0), ("und", 0.0)]


def test_language_query_equals_plain_parsing(spark, docs, sf_dir):
    parser = langid.fit(docs)
    samples = defaultdict(str)  # the same rule by itself
    rows = [r for r in docs.collect() if not brute.held_out(r.doc_id) and r.lang is not None and r.text is not None]
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for lang in {r.lang for r in rows}:
        for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (hashes[r.doc_id], r.doc_id))[:200]:
            if len(samples[lang]) < 40_000:
                samples[lang] = (samples[lang] + " " + r.text[:1000])[:40_000]
    assert parser.langs == sorted(samples)
    norm = lambda t: "".join(map(chr, langid.normalise(t)))
    samples = {k: norm(v) for k, v in samples.items()}
    got = {r.doc_id: r for r in llm_queries.op2_cross_parsing_langid(spark, sf_dir).collect()}
    for r in sorted(docs.collect(), key=lambda r: len(r.text or ""))[:60]:
        cost = {k: greedy_phrases(v, norm(r.text or "")) * np.log2(len(v) + 1) for k, v in samples.items()}
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == min(sorted(cost), key=cost.get)
            least, second = sorted(cost.values())[:2]
            assert abs(got[r.doc_id].score - (1 - least / second)) < 1e-9
        assert got[r.doc_id].held_out == brute.held_out(r.doc_id)


def test_language_of_held_out(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(truth)
    held = [r for r in got if brute.held_out(r.doc_id) and r.lang_pred != "und" and truth[r.doc_id]]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_hard_rows(hard, spark):
    got = by_id(langid.identify(hard, langid.fit(hard)), "doc_id", "lang_pred", "score")
    assert len(got) == len(HARD)
    letterless = {d for d, t in HARD if not any(c.isalpha() for c in t or "")}
    assert all((p == "und") == (d in letterless) for d, p, s in got)
    nothing = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.identify(hard, nothing).collect()} == {"und"}


# 3 token counts


def lengths(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, rows, hard):
    for df, given in ((docs, rows), (hard, HARD)):
        want = sorted(((d, len((t or "").encode()), n, n > 2048) for (d, t), n in zip(given, lengths([t or "" for _, t in given]))), key=str)
        got = token_counts.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"), cache_entries=50, batch_bytes=2000)
        assert by_id(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_token_counts_of_odd_texts(spark):
    odd = ["<|startoftext|>", "a <|endoftext|>b", "Á Å Å", "ΣΑΣ İ", "it's we'll  DON'T", " x y　z", "a\x1cb\x85c d", "1234567", "​‍", "\x00\x01", "́a", "x" * 300, "!!!???", "<|endof text|>", "﻿bom"]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(odd)], table(spark, extra=False).schema)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert [got[i] for i in range(len(odd))] == lengths(odd)


# 4 near-duplicates


def test_near_duplicates(docs, rows):
    want = sorted(brute.near_duplicates(rows, 5, 4, 5), key=str)
    assert any(n for _, _, n in want)
    assert by_id(ngram_jaccard.near_duplicates(docs), "doc_id", "class_id", "n_links") == want


def test_near_duplicates_of_hard_rows(hard):
    given = [r for r in HARD if r[0] is not None]
    got = by_id(ngram_jaccard.near_duplicates(hard.where("doc_id is not null"), 3, 0.5), "doc_id", "class_id", "n_links")
    assert got == sorted(brute.near_duplicates(given, 3, 1, 2), key=str)
    assert ngram_jaccard.near_duplicates(hard).count() == len(HARD)


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "PER_BLOCK", 4)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    given = []
    for i in range(40):
        words = list(base)
        words[rng.integers(60)] = f"new{i}"
        given.append((i, " ".join(words if i % 4 else base)))
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in given], table(spark, extra=False).schema)
    assert by_id(ngram_jaccard.near_duplicates(df), "doc_id", "class_id", "n_links") == sorted(brute.near_duplicates(given, 5, 4, 5), key=str)


def test_single_texts_of_few_words(spark):
    texts = [" ".join("abcdefg"[:n]) for n in range(7)]
    for width in (1, 3, 5):
        assert [len(set(ngram_jaccard.shingles([t.encode()], width)[1].tolist())) for t in texts] == [len(brute.shingle_set(t, width)) for t in texts]
    given = [(i, t) for i, t in enumerate(texts + texts)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(given, len(given)), "doc_id long, text string")
    assert by_id(ngram_jaccard.near_duplicates(df), "doc_id", "class_id", "n_links") == sorted(brute.near_duplicates(given, 5, 4, 5), key=str)


def test_groups_of_two_keep_their_link(spark):
    rng = np.random.default_rng(13)
    given, want = [], {}
    for g in range(20_000):
        words = [f"{g}x{k}" for k in range(int(rng.integers(50, 100)))]
        other = list(words)
        for k in rng.choice(len(words), int(rng.integers(1, 3)), replace=False):
            other[k] = "new"
        a, b = brute.shingle_set(" ".join(words), 5), brute.shingle_set(" ".join(other), 5)
        linked = 5 * len(a & b) >= 4 * len(a | b)
        given += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        want |= {2 * g: (2 * g, int(linked)), 2 * g + 1: (2 * g + (not linked), int(linked))}
    assert sum(n for _, n in want.values()) > 20_000
    df = spark.createDataFrame(given, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard.near_duplicates(df).collect()}
    assert {d: (got.get(d), w) for d, w in want.items() if got.get(d) != w} == {}


def test_pruning_keeps_what_may_reach_the_threshold():
    least = ngram_jaccard.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and 0 < least[-1] < ngram_jaccard.N_HASHES * 0.8


def test_one_of_each_class_stays(docs, rows, hard, spark):
    classes = brute.near_duplicates(rows, 5, 4, 5)
    assert sorted(r.doc_id for r in ngram_jaccard.drop_near_duplicates(docs).collect()) == sorted({c for _, c, _ in classes})
    got = ngram_jaccard.drop_near_duplicates(hard)
    assert got.columns == hard.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids.count(10) == 1 and 2 not in ids and 15 not in ids and 4 in ids and 5 in ids and None in ids


# 5 quality rules


def check_quality(df, given, **options):
    got = quality_rules.judge(df, **options)
    assert by_id(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((d, *brute.quality(t)) for d, t in given), key=str)
    assert all(not (r.base_failed and r.kept) for r in got.select("base_failed", "kept").collect())


def test_quality_base(docs, rows, hard):
    check_quality(docs, rows)
    check_quality(hard, HARD)


def test_quality_query_equals_sql(spark, sf_dir):
    from tests.oracle import connection, difference

    assert difference(llm_queries.op5_quality_rules(spark, sf_dir), connection(sf_dir), llm_queries.OP5_SQL) == ""


def test_thresholds_follow_language_and_source(spark):
    plain, loud = "a plain text of small words that says little", "A LOUD TEXT OF LARGE WORDS THAT SAYS LITTLE "
    words = [f"{plain} in number{i} " + " ".join(f"u{i}v{k}" for k in range(12)) for i in range(60)]
    shout = [loud + " ".join(f"U{i}V{k}" for k in range(20)) for i in range(60)]
    given = [(i, w, "en", "calm", 0) for i, w in enumerate(words)] + [(100 + i, w, "en", "loud", 0) for i, w in enumerate(shout)] + [(500, shout[0] + " ONE MORE", "en", "calm", 0)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(given, table(spark, extra=False).schema), of_lang=15, of_all=5).collect()}
    assert not got[500] and all(v for k, v in got.items() if k != 500)


# 6 fingerprints


def passages(text):
    found = [xx for xx in fingerprints._PASSAGES.findall(text)]
    return Counter(found)


def test_fingerprints(docs, rows, hard):
    for df, given in ((docs, rows), (hard, HARD)):
        given = sorted(given, key=lambda r: (r[0] is not None, r[0]))
        if len({d for d, _ in given}) == len(given) or df is hard:
            texts = [t or "" for _, t in given]
            after = texts[1:] + texts[:1]
            want = []
            for (d, _), t, f in zip(given, texts, after):
                e = fingerprints.edited_text(t, f)
                near = []
                for o in (e, f):
                    a, b = passages(t), passages(o)
                    shared, every = sum((a & b).values()), sum((a | b).values())
                    near.append(round(shared / every, 9) if every else 1.0)
                want.append((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest(), *near))
            got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprint_documents(df, rows_per_bucket=50).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
    prints = {r.fingerprint for r in fingerprints.fingerprint_documents(hard).where("doc_id in (1, 2)").collect()}
    assert len(prints) == 1


def test_peeling_recovers_differing_digests():
    a, b = ["one. two. three. four."], ["one. two. five. four. six."]
    (oa, ka), (ob, kb) = fingerprints.digests(a), fingerprints.digests(b)
    diff = fingerprints.build(1, oa, ka, 24).minus(fingerprints.build(1, ob, kb, 24))
    _, keys, done = diff.peel()
    assert done.all() and set(keys) == set(ka) ^ set(kb) and len(keys) == 3


def test_peeling_retries_larger():
    a = [" ".join(f"sentence{i}." for i in range(400))]
    b = [" ".join(f"other{i}." for i in range(300))]
    ka, kb = fingerprints.digests(a), fingerprints.digests(b)
    small = fingerprints.build(1, *ka, 24), fingerprints.build(1, *kb, 24)
    assert not small[0].minus(small[1]).peel()[2].all()
    assert fingerprints.differences(1, ka, kb, small)[0] == 700


# 7 byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 512), (200, 64), (40, 8)])
def test_byte_bpe_round_trip(docs, rows, hard, encoding, chunk, overlap):
    for df, given in ((docs, rows), (hard, HARD)) if chunk > 100 else ((hard, HARD),):
        want = sorted(((d, np.asarray(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in given), key=str)
        got = byte_bpe.decode_ids(byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=overlap), RANKS)
        assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()), key=str) == want


# 8 line dedup


def check_lines(df, given, keys, threshold, min_chars=20):
    order = sorted(range(len(given)), key=lambda i: (given[i][0] is not None, given[i][0] or 0, keys[i]))
    drops = brute.dedup_lines(given, order, threshold, min_chars)
    got = line_dedup.dedup_lines(df, threshold, min_chars)
    want = []
    for (d, t), gone in zip(given, drops):
        lines = None if t is None else t.split("\n")
        text = t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want.append((d, text, len(lines or []), len(gone), gone))
    assert by_id(got, "doc_id", "text", "n_lines", "n_dropped", "drops") == sorted(want, key=str)


def test_line_dedup(docs, rows):
    assert len({d for d, _ in rows}) == len(rows)
    check_lines(docs, rows, [0] * len(rows), 1)


def test_line_dedup_of_hard_rows(hard):
    given = HARD[:9] + HARD[10:]  # the rows of one doc_id are one document
    once = hard.where("doc_id is null or doc_id <> 10").unionByName(hard.where("doc_id = 10").limit(1))
    check_lines(once, given, [0] * len(given), 1)
    got = line_dedup.dedup_lines(hard).where("doc_id = 10").collect()
    assert len(got) == 2 and got[0].drops == got[1].drops


@pytest.mark.parametrize("threshold", [0, 2, 3])
def test_line_dedup_at_other_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(line_dedup, "PER_BLOCK", 4)
    monkeypatch.setattr(line_dedup.line_classes, "__defaults__", (0, 100, 3))
    rng = np.random.default_rng(threshold)
    base = ["".join(rng.choice(list("abcde "), 24)).strip().ljust(24, "z") for _ in range(6)]
    given = []
    for i in range(24):
        s = list(base[i % 6])
        for _ in range(rng.integers(0, 5)):
            k = int(rng.integers(len(s)))
            s[k : k + 1] = [["", "q", s[k] + "r"][rng.integers(3)]]
        given.append((i, "".join(s) + "\nshort"))
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in given], table(spark, extra=False).schema)
    check_lines(df, given, [0] * len(given), threshold, min_chars=10)


def test_line_dedup_query_grows_with_the_line(spark, monkeypatch):
    rng = np.random.default_rng(17)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(words, rng.integers(3, 40))) for _ in range(30)]
    given = []
    for i in range(90):
        s = base[i % 30].split()
        for _ in range(i // 30):
            s[rng.integers(len(s))] = words[rng.integers(300)]
        given.append((i, " ".join(s) + "\n" + ["yes", "yet", "chapter 1", "chapter 2", ""][i % 5]))
    monkeypatch.setattr(llm_queries, "documents", lambda s, d: spark.createDataFrame([(d, t, None, None, None) for d, t in given], table(spark, extra=False).schema))
    got = {r.doc_id: r.drops for r in llm_queries.op8_segment_line_dedup(spark, "").collect()}
    lines = sorted({x for _, t in given for x in t.split("\n") if x})
    classes, linked = brute.Classes(), 0
    for j in range(len(lines)):
        for i in range(j):
            short = min(len(lines[i]), len(lines[j]))
            most = min(8, short // 10)
            if short >= 20 and abs(len(lines[i]) - len(lines[j])) <= most and (n := brute.edit_distance(lines[i], lines[j])) <= most:
                classes.join(lines[i], lines[j])
                linked += n > 1
    seen, want = set(), {}
    for d, t in given:
        want[d] = [no for no, x in enumerate(t.split("\n")) if x and (classes.find(x) in seen or seen.add(classes.find(x)))]
    assert linked > 20 and got == want


def test_near_lines_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PER_BLOCK", 4)
    monkeypatch.setattr(line_dedup.line_classes, "__defaults__", (0, 100, 3))
    rng = np.random.default_rng(23)
    base = "".join(rng.choice(list("abcdefgh "), 40)).strip().ljust(40, "z")
    given = []
    for i in range(60):  # copies near a common line, chains that leave it step by step, and lines like it in half
        s = list(base)
        for k in range(i % 10 if i < 40 else 1):
            s[4 * k] = "q"
        given.append((i, "".join(s)[: 20 if i > 55 else None] + ("" if i < 50 else f"{i * 7919 % 1000:020d}")))
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in given], table(spark, extra=False).schema)
    for threshold in (1, 2):
        check_lines(df, given, [0] * len(given), threshold, min_chars=10)


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_segments_probe_every_pair_within_the_threshold(threshold):
    rng = np.random.default_rng(7)
    for _ in range(400):
        a = "".join(rng.choice(list("abc"), rng.integers(threshold + 1, 20)))
        s = list(a)
        for _ in range(rng.integers(0, threshold + 1)):
            k = int(rng.integers(len(s))) if s else 0
            s[k : k + 1] = [["", "b", "ca"][rng.integers(3)]]
        b = "".join(s)
        if brute.edit_distance(a, b) <= threshold and min(len(a), len(b)) > threshold:
            owner, key, indexed = line_dedup.segment_keys([a, b], threshold)
            ka, kb = ({k: i for o, k, i in zip(owner, key, indexed) if o == line} for line in (0, 1))
            assert any(ka[k] or kb[k] for k in set(ka) & set(kb))


def test_sketches_tell_chance_from_near_lines():
    """Lines of the same few syllables share segments by chance: of a thousand such pairs sketches let at most 60 pass, and
    every pair within the edits allowed."""
    rng = np.random.default_rng(5)
    syllables = ["th", "an", "er", "on", "the", "ing", "and", "st", "re", "en", "ha", "nt", "ed", "ou", "ea", "ti", " ", " ", ". "]
    lines = ["".join(rng.choice(syllables, 60))[:100] for _ in range(1000)]
    for k in range(0, 1000, 2):
        s = list(lines[k])
        for _ in range(8):
            at = int(rng.integers(len(s)))
            s[at : at + 1] = [["", "x", "th"[rng.integers(2)] + s[at]][rng.integers(3)]]
        lines.append("".join(s))
    size, few, many = line_dedup.sketches(lines)
    test = line_dedup.like_sketches(size | 1, few, many, threshold=8, percent=10)
    assert test(np.arange(0, 1000), np.roll(np.arange(0, 1000), 1)).sum() <= 60
    x, y = np.arange(0, 1000, 2), np.arange(1000, 1500)
    near = line_dedup.within([line_dedup.code_points(s) for s in lines], x, y, 8, 10)
    assert near.sum() > 400 and test(x, y)[near].all()


@pytest.mark.parametrize("held_rows", [50, 1 << 21])
def test_keys_of_lines_go_in_packed_buckets(monkeypatch, held_rows):
    """A task sends one value for each bucket, not a row for each key; keys with many lines leave a full bucket at once,
    and the others are compared as plain pairs are."""
    monkeypatch.setattr(line_dedup, "HELD_ROWS", held_rows)
    rng = np.random.default_rng(29)
    base = ["".join(rng.choice(list("abcdefgh "), 60)).strip().ljust(60, "z") for _ in range(20)]
    texts = [b[:k] + "q" + b[k + 1 :] for b in base for k in range(0, 60, 7)] + ["same start of many lines " + b for b in base]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = list(line_dedup._keyed(8, 10, 20, 4)(iter([batch])))
    assert sum(b.num_rows for b in out) <= 4
    twice = pa.Table.from_batches(out + out).combine_chunks().sort_by("bucket").to_batches()  # as from two tasks
    want = defaultdict(set)
    for b in out:
        for r in line_dedup._unpacked(b.column("rows")).tolist():
            want[r[0] >> line_dedup.KEY_BITS].add(tuple(r))
    met = {k for k, v in want.items() if len(v) > 1 and any(r[0] & 1 for r in v)}
    few, many = set(), set()
    for whole, large in line_dedup._bucket_rows(iter(twice), 12, least_rows=1):
        few.update(map(tuple, whole.tolist()))
        many.update(map(tuple, large.tolist()))
    # rows of keys that one line has, or that none is indexed under, link nothing
    few, many = ({r for r in rows if r[0] >> line_dedup.KEY_BITS in met} for rows in (few, many))
    assert few == {r for k in met if len(want[k]) <= 12 for r in want[k]}
    assert many == {r for k in met if len(want[k]) > 12 for r in want[k]} and many


def star_rows(stars: dict[int, list[tuple[int, str]]]) -> pa.Table:
    """Rows as _verified takes them: in the order of at, those of the line that id is at first."""
    rows = [(at, i, f"{at}-{i}-{k}".encode(), s) for at in sorted(stars) for k, (i, s) in enumerate(sorted(stars[at], key=lambda r: r[0] != at))]
    return pa.table([pa.array(c) for c in zip(*rows)], ["at", "id", "lid", "line"])


@pytest.mark.parametrize("verified_bytes", [1, 500, 1 << 22])
def test_stars_of_lines_are_verified_in_portions(monkeypatch, verified_bytes):
    """A line meets all that it may be near, whatever portions of its group these come in."""
    monkeypatch.setattr(line_dedup, "VERIFIED_BYTES", verified_bytes)
    monkeypatch.setattr(line_dedup, "TESTED_PAIRS", 3)
    monkeypatch.setattr(line_dedup, "COUNTED_CHARS", 70)
    rng = np.random.default_rng(31)

    def near(s: str, n: int) -> str:
        s = list(s)
        for k in rng.integers(0, len(s), n):
            s[k] = "q"
        return "".join(s)

    base = ["".join(rng.choice(list("abcdefgh "), 60)) for _ in range(4)]
    stars = {at: [(at, b), *((at + 1 + k, near(b, k % 7)) for k in range(40))] for at, b in zip((100, 200, 300, 400), base)}
    stars[200].insert(7, (200, near(base[1], 2)))  # two lines of one short id
    stars[500] = [(500, base[0])]
    t = star_rows(stars)
    lid, ids, at, lines = (t.column(c).to_pylist() for c in ("lid", "id", "at", "line"))
    want = {frozenset((lid[i], lid[j])) for i in range(len(ids)) for j in range(len(ids)) if i != j and ids[i] == at[i] == at[j] and brute.edit_distance(lines[i], lines[j]) <= 3}
    got = [frozenset(p) for b in line_dedup._verified(8, 5)(t.to_batches(max_chunksize=13)) for p in zip(*(b.column(c).to_pylist() for c in "ab"))]
    assert set(got) == want and len(want) > 80


def test_memory_of_verifying_long_lines_is_bounded():
    rng = np.random.default_rng(37)
    text = "".join(rng.choice(list("abcdefghijklmnop "), 100_000))
    t = star_rows({1: [(1 + k, text[(at := int(rng.integers(99_000))) : at + 700]) for k in range(12_000)]}).combine_chunks()
    tracemalloc.start()
    try:
        for _ in line_dedup._verified(8, 5)(t.to_batches()):
            pass
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()


def test_pairs_of_a_large_group_come_in_portions():
    at, own = np.array([0, 700, 702, 705, 1705]), np.arange(1705) % 2
    zero, one = np.zeros(1705, np.int32), np.ones(1705, np.int32)
    for hi in (zero, one):
        want = {(i, j) for a, z in zip(at, at[1:]) for i in range(a, z) for j in range(i + 1, z) if hi is zero or own[i] != own[j]}
        got = list(_blocks.pairs_of(at, zero, hi, own, at_most=5000))
        assert max(len(x) for x, _ in got) <= 10_000
        pairs = [tuple(sorted(p)) for x, y in got for p in zip(x.tolist(), y.tolist())]
        assert len(pairs) == len(want) and set(pairs) == want
    got = [p for x, y in line_dedup._pairs_within(np.array([3, 200]), np.array([3, 40])) for p in zip(x.tolist(), y.tolist())]
    assert sorted(got) == [(i, j) for a, n, k in ((0, 3, 3), (3, 200, 40)) for i in range(a, a + k) for j in range(i + 1, a + n)]


def test_groups_of_long_rows_come_in_bounded_tables(monkeypatch):
    monkeypatch.setattr(_blocks, "PORTION_BYTES", 4000)
    groups = [1] * 5 + [2] * 90 + [3] * 40 + [4] * 65
    t = pa.table([pa.array(groups), pa.array(["x" * 100] * 200)], ["g", "s"])
    got = list(_blocks.whole_groups(t.to_batches(), ["g"]))
    assert sum((t.column("g").to_pylist() for t, _ in got), []) == groups
    assert all(len(set(t.column("g").to_pylist()[a:z])) == 1 for t, at in got for a, z in zip(at, at[1:])) and sum(len(at) - 1 for _, at in got) == 4
    assert max(t.num_rows for t, _ in got) < 200


def test_lines_are_numbered_as_python_splits_them(monkeypatch):
    monkeypatch.setattr(line_dedup, "PORTION_CHARS", 9)
    texts = ["", "a\n\n b ", "\n", "é\t\n xx\x0b\x0c\r\n日本語 \n", "q"]
    for least in (0, 1, 3):
        got = [x for rows, numbers, lines in line_dedup._numbered(pa.array(texts), least) for x in zip(rows, numbers, lines.to_pylist())]
        want = [(k, no, s) for k, t in enumerate(texts) for no, line in enumerate(t.split("\n")) if len(s := line.strip(line_dedup.BLANKS)) >= least]
        assert got == want


def test_banded_distance():
    rng = np.random.default_rng(11)
    lines = ["".join(rng.choice(list("ab"), rng.integers(1, 14))) for _ in range(60)]
    x, y = (g.ravel() for g in np.meshgrid(np.arange(60), np.arange(60)))
    for t in (1, 2, 3):
        got = line_dedup.within([line_dedup.code_points(s) for s in lines], x, y, t)
        assert got.tolist() == [brute.edit_distance(lines[i], lines[j]) <= t for i, j in zip(x, y)]


# 9 personal data


def check_pii(df, given):
    want = []
    for d, t in given:
        f = brute.base_spans(t)
        want.append((d, *(len(f[k]) for k in ("email", "ip", "card", "phone")), brute.base_sha256(f)))
    got = pii.find_personal_data(df)
    assert by_id(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=str)


def test_personal_data(docs, rows, hard):
    check_pii(docs, rows)
    check_pii(hard, HARD)


def test_personal_data_of_odd_texts(spark):
    odd = [
        "a@b a@b.c a@b.c.d@e.f x@-.- @a.b a..b@c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 01.002.3.4 1.2.3",
        "4111-1111 1111-1111 4111  1111 1111 1111 41111111111111110 4111 1111 1111 1111 5500005555555559", "+1 (2) 3 4 5 6 7 8 +123456789012345 +1234567 ++49 30 123456 +49-30-123456- +1.2.3.4.5.6.7.8.9",
        "\U0001f600a@b.co \U0001f600 +49 30 1234567 é10.0.0.1", "1" * 40 + " " + "4111111111111111" * 3, "a@b.co,c@d.co;+4930123456710.0.0.1", "x" * 3000 + "@" + "y" * 3000, "1." * 500, "a.a@" * 200, "+" * 200 + "1" * 10, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4111 1111 1111 1111 2 4111 1111 1111 1111",
    ]
    given = list(enumerate(odd))
    check_pii(spark.createDataFrame([(d, t, None, None, None) for d, t in given], table(spark, extra=False).schema), given)


def test_patterns_discover_identifiers(spark):
    given = [(i, f"please write to us: mail me at person{i}@site{i}.org today or later", None, None, None) for i in range(20)]
    given += [(100, "please write to us: mail me at someone@localhost today or later", None, None, None), (101, "the price is 1234567890 or less", None, None, None)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(given, table(spark, extra=False).schema)).collect()}
    s = given[20][1].index("someone")
    assert got[100].spans == f"email:{s}:{s + len('someone@localhost')}" and got[100].n_email == 0
    assert got[101].spans == "" and got[0].n_found == 0


def test_secrets_that_begin_with_digits(spark):
    """A token is one mention as a whole, however many digits it begins with."""
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)] + ["186661156f3f9905942d70850a01cbf23a203f82", "69109448945250aa" * 2, "1234567e8"]
    given = [(i, f'some words and token = "{x}" and more', None, None, None) for i, x in enumerate(hexes)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(given, table(spark, extra=False).schema)).collect()}
    at = given[0][1].index('"') + 1
    assert [got[i].spans for i in range(42)] == [f"secret:{at}:{at + len(x)}" for x in hexes[:42]]
    assert got[42].spans == ""


def mention_spans(t):
    """Start and end of the identifier-like strings, by walking over the characters."""
    import string

    alnum, token = set(string.ascii_letters + string.digits), set(string.ascii_letters + string.digits + "._%+@-")
    out, i = [], 0
    while i < len(t):
        end, before = 0, t[i - 1] if i else ""
        first = i + (t[i] in "(+")
        if before not in alnum and first < len(t) and t[first] in string.digits:
            run = first
            while run < len(t) and t[run] in "0123456789() .-":
                run += 1
            fits = [e for e in range(first + 7, run + 1) if t[e - 1] in string.digits and not (e < len(t) and t[e] in alnum | set("_%+@"))]
            end = max(fits, default=0)
        if not end and before not in token:
            run = i
            while run < len(t) and t[run] in token:
                run += 1
            if run - i >= 5 and any(c in "0123456789@" for c in t[i:run]):
                end = run
        if end:
            out.append((i, end))
        i = end or i + 1
    return out


def plain_personal_data(given, rounds, min_seeds, min_confidence):
    """doc_id, spans and number of added ones, by loops and dicts."""
    import math
    import re

    names = ("email", "ip", "card", "phone", "secret")
    mentions, based = [], {}
    for d, t in given:
        found = brute.base_spans(t)
        based[d] = [(k, *s) for k in names[:4] for s in found[k]]
        for start, stop in mention_spans(t or ""):
            before, after = t[max(start - 64, 0) : start].lower(), t[stop : stop + 48].lower()
            s = t[start:stop].lower()
            over = [k for k, a, z in based[d] if a < stop and z > start]
            seed = over[0] if over else "secret" if re.fullmatch("(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}", s) else None
            patterns = []
            if w := re.search(r"([^\W\d_]|[:=])+(?![^\W\d_]|[:=])([^\w\n:=]|[\d_])+([^\W\d_]|[:=])+([^\w\n:=]|[\d_])*$", before):
                patterns.append("<" + re.sub(r"([^\w:=]|[\d_])+", " ", w.group()))
            one = re.search(r"((?:[^\W\d_]|[:=])+)(?:[^\w\n:=]|[\d_])*$", before)
            behind = re.match(r"(?:[^\w\n]|[\d_])*([^\W\d_]+)", after)
            if one and behind:
                patterns.append(f"<> {one.group(1)} {behind.group(1)}")
            if w := re.search(r"[^\W\d_]+\s?(?:[^\w\s]|[\d_])\s?(?:[^\w\s]|[\d_])?$", before):
                patterns.append("|" + re.sub(r"\s", "", w.group()))
            mentions.append((d, start, stop, s, over, seed, patterns))
    seed_of, edges = {}, defaultdict(set)
    for *_, s, over, seed, patterns in mentions:
        for p in patterns:
            edges[p].add(s)
            if seed:
                seed_of[s] = max(seed_of.get(s, ""), seed)

    def fits(kind, s):
        n, bare = sum(c.isdigit() for c in s), re.fullmatch(r"[0-9()+ .-]+", s)
        return {"email": "@" in s, "ip": bool(re.fullmatch(r"[0-9]{1,3}([.][0-9]{1,3}){3}", s)), "card": bool(bare) and 13 <= n <= 19, "phone": bool(bare) and 7 <= n <= 15, "secret": len(s) >= 16 and bool(re.search("[0-9]", s)) and bool(re.search("[a-z]", s)) and "@" not in s}[kind]

    belief = {(k, s): 1.0 for s, k in seed_of.items()}
    trusted = {}
    for _ in range(rounds):
        trusted = {}
        for p, insts in edges.items():
            for k in names:
                values = [belief[k, s] for s in insts if (k, s) in belief]
                if sum(v >= min_confidence for v in values) >= min_seeds and sum(values) / len(insts) >= min_confidence:
                    trusted[p, k] = sum(values) / len(insts)
        belief = {(k, s): 1.0 for s, k in seed_of.items()}
        for p, k in trusted:
            for s in edges[p]:
                if s not in seed_of and fits(k, s):
                    belief[k, s] = 1 - math.prod([1 - min(trusted[q, k], 1 - 1e-9) for q in edges if (q, k) in trusted and s in edges[q]])
    out = []
    added = defaultdict(set)
    for d, a, z, s, over, _, patterns in mentions:
        best = sorted((-trusted[p, k], names.index(k)) for p in patterns for k in names if (p, k) in trusted and fits(k, s))
        if best and not over:
            added[d].add((names[best[0][1]], a, z))
    for d, _ in given:
        spans = sorted([*based[d], *added[d]], key=lambda x: (names.index(x[0]), x[1]))
        out.append((d, ",".join(f"{k}:{a}:{z}" for k, a, z in spans), len(spans), len(added[d])))
    return out


def test_bootstrapped_spans_equal_plain_ones(spark, docs, rows):
    rng = np.random.default_rng(12)
    pick = lambda *words: str(rng.choice(words))
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    given = []
    for i in range(3000):
        kind = i % 6
        if kind == 0:
            what = f"please write: mail me at {pick('jo', 'al')}{i}@" + pick(f"site{i}.org", f"site{i}.org", f"site{i}.org", f"site{i}.org", f"site{i}.org", "intranet")
        elif kind == 1:
            what = f"my phone is {pick('+', '+', '+', '+', '+', '+', '')}49 30 {number(7)} all day"
        elif kind == 2:
            what = f'set token = "{"".join(rng.choice(list("0123456789abcdef"), 40)) if i % 9 else "Key-" + number(12) + "-xyz"}" there'
        elif kind == 3:
            what = f"{pick('call', 'ring')} {pick('us', 'me')} on {pick('+', '')}1 {number(3)} {number(3)} {number(4)} or {pick('fax', 'write')}"
        elif kind == 4:
            what = f"order {number(9)} came to {pick('our', 'the')} house with part a{number(6)}"
        else:  # reached in a second round, by identifiers that the first one has found
            what = f"reply via jo{i - 5}@intranet soon, secretkey: Key-{number(12)}-xyz"
        given.append((i, what + pick("", "\nand more", " or so")))
    df = spark.createDataFrame(given, "doc_id long, text string")
    for options in ({}, {"rounds": 1}, {"min_seeds": 20, "min_confidence": 0.5}):
        want = plain_personal_data(given, options.get("rounds", 3), options.get("min_seeds", 5), options.get("min_confidence", 0.8))
        assert sum(w[3] for w in want) > 50
        assert by_id(pii.find_personal_data(df, **options), "doc_id", "spans", "n_spans", "n_found") == sorted(want, key=str)
    assert by_id(pii.find_personal_data(docs), "doc_id", "spans", "n_spans", "n_found") == sorted(plain_personal_data(rows, 3, 5, 0.8), key=str)


def test_many_spans_of_one_text(spark):
    text = " ".join(f"a{i}@b{i}.org" for i in range(1000))
    got = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.spans == ",".join(f"email:{a}:{z}" for a, z in brute.base_spans(text)["email"]) and got.n_spans == 1000


# 10 mixing


def test_mixing_query_equals_sql(spark, sf_dir):
    from tests.oracle import connection, difference

    assert difference(llm_queries.op10_poisson_mix(spark, sf_dir), connection(sf_dir), llm_queries.OP10_SQL) == ""


def test_mixing(hard, spark):
    got = mixing.poisson_mix(hard).collect()
    keys = [r.shuffle_key for r in got]
    assert len({(r.doc_id, r.text, r.copy_no) for r in got}) >= len({(r.doc_id, r.text) for r in got})
    assert all(1 <= r.copy_no <= r.n_copies for r in got) and keys
    rate = {r.source: r.rate for r in got}
    n = Counter(r[3] for r in hard_rows())
    total = sum(v**0.5 for v in n.values())
    assert all(abs(v - len(HARD) * n[s] ** 0.5 / total / n[s]) < 1e-9 for s, v in rate.items())
    many = spark.range(20_000).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "if(id % 4 = 0, 'a', 'b') as source", "1L as n_chars")
    c = Counter(r.source for r in mixing.poisson_mix(many, weights={"a": 3, "b": 1}, out_rows=40_000).select("source").collect())
    assert abs(c["a"] - 30_000) < 900 and abs(c["b"] - 10_000) < 600
    assert mixing.poisson_mix(many, weights={"a": 1}).where("source = 'b'").count() == 0


def test_large_rates(spark):
    one = spark.createDataFrame([(i, "t", "en", "a", 1) for i in range(30)], table(spark, extra=False).schema)
    got = mixing.poisson_mix(one, weights={"a": 1}, out_rows=30 * 800).select("doc_id").collect()
    assert abs(len(got) - 24_000) < 6 * 24_000**0.5


def test_poisson_cdf(spark):
    import math

    for rate in (0.3, 5.0, 150.0, 3000.0):
        r = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("p")).first().p
        for at in (0, len(r.cdf) // 3, len(r.cdf) // 2, len(r.cdf) - 1):
            k = r.first + at
            want = math.fsum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1))
            assert abs(r.cdf[at] - want) < 1e-9


# empty tables


@pytest.mark.parametrize("name", [n for n in llm_queries.queries() if n.startswith("op")])
def test_empty_table(spark, name, monkeypatch):
    monkeypatch.setattr(llm_queries, "documents", lambda s, d: empty(spark))
    assert llm_queries.queries()[name](spark, "").count() == 0


