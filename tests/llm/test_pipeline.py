"""The corpus pipeline against plain versions of its stages, and its stages on hard cases."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from annotide.llm.queries import OP5_SQL
from tests.llm import brute
from tests.llm.data import empty, hard_rows, table
from tests.oracle import connection


def poisson_count(rate: float, doc_id) -> int:
    u = int(hashlib.md5(f"mix:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def encoding() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_pipeline(sf_dir: str) -> Counter:
    con = connection(sf_dir)
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({OP5_SQL}) WHERE kept").fetchall()}
    docs = [r for r in con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    drops = brute.dedup_lines([(d, t) for d, t, *_ in docs], list(range(len(docs))), 8, 1, 20, 5)
    left = []
    for (d, t, lang, source, n), gone in zip(docs, drops):
        if gone:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            n = len(t)
        if not gone or t.strip(brute.BLANKS):
            left.append((d, t, lang, source, n))
    classes = brute.near_duplicates([(d, t) for d, t, *_ in left], 5, 4, 5)
    left = [r for r, (d, c, _) in zip(left, classes) if d == c]
    by_source = Counter(r[3] for r in left)
    whole = sum(v**0.5 for v in by_source.values())
    enc = encoding()
    out = Counter()
    for d, t, lang, source, n in left:
        copies = poisson_count(len(left) * by_source[source] ** 0.5 / whole / by_source[source], d)
        if copies:
            ids = np.asarray(enc.encode_ordinary(t), "<u4").tobytes()
            out[d, lang, source, n, ids, len(ids) // 4] += copies
    return out


def test_pipeline_equals_plain_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens"]
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, bytes(r.ids), r.n_tokens) for r in got.collect()) == plain_pipeline(sf_dir)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_hard_rows(spark, name, stage):
    hard = table(spark)
    got = stage(spark, hard, "")
    if name != "byte_bpe":
        assert got.columns == hard.columns
    assert got.count() > 0
    assert stage(spark, empty(spark), "").count() == 0


def by_stage(spark, name, *columns, rows=None):
    got = dict(corpus_pipeline.STAGES)[name](spark, table(spark, rows), "")
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=str)


def test_quality_stage_on_hard_rows(spark):
    assert by_stage(spark, "quality_rules", "doc_id") == sorted(((d,) for d, t, *_ in hard_rows() if not brute.quality(t)[-1]), key=str)


def test_line_stage_on_hard_rows(spark):
    short = lambda t: None if t is None else "\n".join(t.split("\n")[:40])  # noqa: E731  all pairs of lines are compared
    rows = [(d, short(t), lang, s, n) for d, t, lang, s, n in hard_rows()]
    once = [r for i, r in enumerate(rows) if r not in rows[:i]]  # rows that are repeated keep the same lines
    order = sorted(range(len(once)), key=lambda i: (once[i][0] is not None, once[i][0] or 0))
    left = {}
    for (d, t, *_), gone in zip(once, brute.dedup_lines([r[:2] for r in once], order, 8, 1, 20, 5)):
        kept = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        left[d, t] = None if gone and not kept.strip(brute.BLANKS) else (d, kept, len(kept) if gone else None)
    want = [(d, w[1], n if w[2] is None else w[2]) for d, t, _, _, n in rows if (w := left[d, t])]
    assert by_stage(spark, "line_dedup", "doc_id", "text", "n_chars", rows=rows) == sorted(want, key=str)


def test_near_stage_on_hard_rows(spark):
    rows = hard_rows()
    classes = brute.near_duplicates([(d if d is not None else -1, t) for d, t, *_ in rows], 5, 4, 5)
    first, want = {}, []
    for (d, t, *_), (_, c, n) in zip(rows, classes):
        if not n:
            want.append((d, t))
        elif c not in first:
            first[c] = min((x, y) for (x, y, *_), (_, k, m) in zip(rows, classes) if k == c and m)
            want.append(first[c])
    assert by_stage(spark, "near_duplicates", "doc_id", "text") == sorted(want, key=str)


def test_mixing_stage_on_hard_rows(spark):
    rows = hard_rows()
    n = Counter(r[3] for r in rows)
    whole = sum(v**0.5 for v in n.values())
    want = [(d, t) for d, t, _, s, _ in rows for _ in range(poisson_count(len(rows) * n[s] ** 0.5 / whole / n[s], d))]
    assert by_stage(spark, "mixing", "doc_id", "text") == sorted(want, key=str)


def test_encoding_stage_on_hard_rows(spark):
    enc = encoding()
    want = [(d, lang, s, n, np.asarray(enc.encode_ordinary(t or ""), "<u4").tobytes()) for d, t, lang, s, n in hard_rows()]
    got = [(*r[:4], bytes(r[4])) for r in by_stage(spark, "byte_bpe", "doc_id", "lang", "source", "n_chars", "ids")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "byte_bpe"]
