"""The automaton against the regular expressions that it is made of."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from annotide.llm import automaton, queries, secrets
from annotide.llm.automaton import Rule, compile_rules, scan
from tests.llm.data import empty, hard_rows, table
from tests.oracle import connection, difference

#: The contract's own expressions; the least length is that of the whole match, but of group 2 for assign.
BASE = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
]
PARTS = ["token", "=", " ", '"', ":", "password", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "\n", "x", "secret", "api_key", "apikey", "ToKeN", "ghp_", "a" * 40, "eyJab", ".eyJcd", ".zz" * 10, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "bearer  ", "é", "\U0001f600", " " * 300, "f" * 700, "passwd", "'", "abcdef", "sk_live_", "-"]


def random_texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def base_spans(t: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, rx, least) in enumerate(BASE):
        out += [(m.start(), m.end(), k) for m in rx.finditer(t) if len(m[2] if kind == "assign" else m[0]) >= least]
    return sorted(out, key=lambda m: (m[0], m[2]))


def more_spans(t: str) -> list[tuple[int, int, int]]:
    out = []
    for k, r in enumerate(secrets.MORE, len(BASE)):
        out += [(m.start(), m.end(), k) for m in re.finditer(f"{r.head}({r.value})", t) if len(m[1]) >= r.least]
    return out


def expected(d, t) -> tuple:
    t = t or ""
    base, more = base_spans(t), more_spans(t)
    kinds = [r.kind for r in secrets.BASE + secrets.MORE]
    told = lambda found: ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in sorted(found, key=lambda m: (m[0], m[2])))
    return (d, *(sum(m[2] == k for m in base) for k in range(3)), hashlib.sha256(told(base).encode()).hexdigest(), told(base + more), len(base + more), len(more))


def check(df, given):
    assert sorted(map(tuple, secrets.find_secrets(df).collect()), key=str) == sorted((expected(d, t) for d, t in given), key=str)


def test_random_texts(spark):
    given = list(enumerate(random_texts(1500, 1)))
    check(spark.createDataFrame(given, "doc_id long, text string"), given)


def test_hard_rows(spark):
    check(table(spark), [r[:2] for r in hard_rows()])
    assert secrets.find_secrets(empty(spark)).count() == 0


def test_odd_texts(spark):
    odd = [
        "token=token: abcdefgh", "token==abcde", "token==abcdef", "token = 'abc' password: \"abcdef\"", "APIKEY:aaaaaa apiKey = bbbbb Api_Key=cccccc", "tokentoken=abcdef secretoken:ghijkl",
        "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAKIA" + "1" * 13, "xAKIA" + "B" * 20 + "c", "a" * 23 + "g" + "a" * 24, "A" + "0" * 24 + "é" + "f" * 30, "token" + " " * 5000 + "=" + " " * 5000 + "abcdef",
        "0f" * 20000, "é" * 1000 + "token=é" + "token=abcdef\U0001f600" + "0" * 24, "", "\x00\n", "passwd'  :  \"a.b-c_d=\"", "-----BEGIN RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY----- -----BEGIN  PRIVATE KEY-----",
    ]
    given = list(enumerate(odd))
    check(spark.createDataFrame(given, "doc_id long, text string"), given)


@pytest.mark.parametrize("lane", [1, 2, 7, 256])
def test_lanes_agree_with_one_pass(monkeypatch, lane):
    """States of lanes that are read side by side are those of one reading from the end."""
    scanner = compile_rules(secrets.BASE + secrets.MORE)
    data = "".join(random_texts(30, 3)).encode()
    padded = np.frombuffer(data + bytes([automaton.BREAK]) * (-len(data) % 1792), np.uint8)
    a = scanner.back
    want, s = np.empty(len(padded), np.int32), 0
    for k in range(len(padded) - 1, -1, -1):
        s = want[k] = a.table[s * a.width + a.column[padded[k]]]
    monkeypatch.setattr(automaton, "LANE", lane)
    assert (automaton.states(a, padded) == want).all()


def test_minimal_and_general_rules():
    """Any rules: counted repeats, branches, optional parts and characters beyond ASCII; the leftmost longest match."""
    rules = (Rule("a", "", "(?:ab|abc|b){1,3}"), Rule("b", "x?", "é+y{0,2}", 2), Rule("c", "", "[0-9]{2,3}"))
    scanner = compile_rules(rules)
    assert scan(scanner, [b"abcbz", "xééyyy éy é".encode(), b"1 12 12345"]) == [[(0, 4, 0)], [(0, 7, 1), (9, 12, 1)], [(2, 4, 2), (5, 8, 2), (8, 10, 2)]]
    n = len(scanner.back.marks)
    rows = {(scanner.back.marks[i], tuple(scanner.back.table[i * scanner.back.width : (i + 1) * scanner.back.width])) for i in range(n)}
    assert len(rows) == n
    with pytest.raises(ValueError):
        compile_rules((Rule("empty", "", "a*"),))
    with pytest.raises(ValueError):
        compile_rules((Rule("anchor", "", "^a"),))


def test_query(spark, sf_dir):
    assert difference(queries.op12_secret_scan(spark, sf_dir), connection(sf_dir), queries.OP12_SQL) == ""
