"""Plain single-process versions of the operators, for small inputs. They share no code with the library."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Classes:
    """Union-find whose representative is the least member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def shingle_set(text: str | None, width: int) -> set:
    words = WORD.findall(text or "")
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def near_duplicates(rows: list[tuple[int, str | None]], width: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """doc_id, class, links of each row; links of similarity num/den or more."""
    sets = [shingle_set(t, width) for _, t in rows]
    classes, links = Classes(), Counter()
    for i in range(len(rows)):
        classes.find((rows[i][0], i))
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * len(sets[i] | sets[j]):
                    classes.join((rows[i][0], i), (rows[j][0], j))
                    links[i] += 1
                    links[j] += 1
    return [(d, classes.find((d, i))[0], links[i]) for i, (d, _) in enumerate(rows)]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


BLANKS = " \t\n\x0b\x0c\r"


def dedup_lines(rows: list[tuple], order: list[int], threshold: int, min_chars: int, edit_chars: int = 0, percent: int = 100) -> list[list[int]]:
    """Line numbers dropped from each row (doc_id, text); order: row numbers in the order of documents."""
    if percent < 100:
        return _drops(rows, order, min_chars, lambda lines, classes: _join_near(lines, classes, threshold, edit_chars, percent))

    def join(lines: list[str], classes: Classes) -> None:
        _join_within(lines, classes, threshold)

    return _drops(rows, order, min_chars, join)


def _join_near(lines: list[str], classes: Classes, threshold: int, edit_chars: int, percent: int) -> None:
    """Joins lines within their share of edits; counts of characters rule most pairs out."""
    lines = sorted((s for s in lines if len(s) >= edit_chars), key=len)
    counts = [Counter(s) for s in lines]
    for j, b in enumerate(lines):
        for i in range(j - 1, -1, -1):
            most = min(len(lines[i]) * percent // 100, threshold)
            if len(b) - len(lines[i]) > threshold:
                break
            if classes.find(lines[i]) != classes.find(b) and len(b) - len(lines[i]) <= most and ((counts[i] - counts[j]).total() <= most and (counts[j] - counts[i]).total() <= most) and edit_distance(lines[i], b) <= most:
                classes.join(lines[i], b)


def _drops(rows: list[tuple], order: list[int], min_chars: int, join) -> list[list[int]]:
    found = [[(no, s) for no, line in enumerate((t or "").split("\n")) if len(s := line.strip(BLANKS)) >= min_chars] for _, t in rows]
    lines = sorted({s for f in found for _, s in f})
    classes = Classes()
    join(lines, classes)
    seen, out = set(), [[] for _ in rows]
    for i in order:
        for no, s in found[i]:
            c = classes.find(s)
            if c in seen:
                out[i].append(no)
            seen.add(c)
    return out


def _join_within(lines: list[str], classes: Classes, threshold: int) -> None:
    if threshold == 1:
        cut = defaultdict(list)
        for s in lines:
            for v in {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}:
                cut[v].append(s)
        pairs = {(g[i], g[j]) for g in cut.values() for j in range(len(g)) for i in range(j)}
    else:
        pairs = {(lines[i], lines[j]) for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= threshold}
    for a, b in pairs:
        if edit_distance(a, b) <= threshold:
            classes.join(a, b)


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    return {kind: [m.span() for m in re.finditer(rule, text or "") if ok(m.group())] for kind, rule, ok in RULES}


def base_sha256(found: dict[str, list[tuple[int, int]]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, _, _ in RULES for s, e in found[k]).encode()).hexdigest()


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
