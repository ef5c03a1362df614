"""Secrets in texts: all rules' expressions compiled to one automaton that reads every byte once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.llm.automaton import Rule, compile_rules, scan

#: The base rules. A run of hexadecimal digits is a match as a whole or not at all, so its least length is in its expression.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", "", r"[0-9a-f]{24,}", 24),
)
#: Credentials whose published formats begin with a fixed mark.
MORE = (
    Rule("github", "", r"gh[oprsu]_[A-Za-z0-9]+", 36),
    Rule("slack", "", r"xox[abeprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("bearer", r"(?i:bearer)\x20+", r"[A-Za-z0-9+/_.~=-]+", 20),
    Rule("private", "", r"-----BEGIN\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY-----"),
)
#: Bytes of texts that are scanned together; a longer text is scanned alone.
PIECE = 1 << 22


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > PIECE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Places in bytes as places in code points; found is sorted by start."""
    if text.isascii():
        return found
    at, n, place = 0, 0, {}
    for b in sorted({x for s, e, _ in found for x in (s, e)}):
        n += len(text[at:b].decode(errors="replace"))
        at = place[b] = b
        place[b] = n
    return [(place[s], place[e], r) for s, e, r in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, n_base: int = len(BASE)) -> DataFrame:
    """doc_id, n_<kind> of each of the first n_base rules, base_sha256, spans, n_spans and n_found for every row.

    spans holds kind:start:end (code points, end exclusive) of all rules by start, then rule, comma-joined; base_sha256
    is the hash of the same of the first n_base rules alone, n_found the number of the others. Null texts are empty
    ones. Repeated rows come out each; other columns are ignored; an empty table gives an empty result. The automaton
    is built on the driver, from the rules alone, and goes to the tasks with their code.
    """
    scanner = compile_rules(rules)
    base = [r.kind for r in rules[:n_base]]
    names = ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", "n_spans", "n_found"]
    kinds = ["bigint", *("bigint" for _ in base), "string", "string", "bigint", "bigint"]

    def told(found: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{rules[r].kind}:{s}:{e}" for s, e, r in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for part in _pieces([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]):
                for text, found in zip(part, scan(scanner, part)):
                    found = _in_code_points(text, found) if found else found
                    own = [x for x in found if x[2] < n_base]
                    rows.append((*(sum(x[2] == r for x in own) for r in range(n_base)), hashlib.sha256(told(own).encode()).hexdigest(), told(found), len(found), len(found) - len(own)))
            cols = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            types = [pa.int64() if k == "bigint" else pa.string() for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
