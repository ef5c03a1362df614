"""Language identification by cross-parsing entropy.

A suffix automaton is built over a bounded sample of labelled text of each language. A text is parsed against
it greedily into the longest phrases that occur in the sample; a phrase costs the logarithm of the sample's length, and
the language with the least cost wins. A step that fails closes the phrase, and its character starts the next one; a
character that the sample lacks ends the phrase before it, or is one by itself. Texts are parsed whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, and its lower case (a space for all that are not letters)."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    lower = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha() and unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            letter[c] = True
            lower[c] = ord(low) if len(low) == 1 else c
    return letter, lower


def normalise(text: str) -> np.ndarray:
    """Code points of the text, lower case, with every run of other characters than letters as one space."""
    letter, lower = _letters()
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = lower[cp]
    space = ~letter[cp]
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = ~(space[1:] & space[:-1])
    return out[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the automaton that accepts every substring of codes; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def displaced(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of all states in one array: that of state s under c is at base[s] + c, as s << 32 | next.

    Rows are laid over each other where their characters leave gaps, those of most characters first, and rows of one
    character fill what is left, so the array takes little more room than there are transitions, whatever the alphabet.
    """
    n = sum(map(len, rows))
    used = bytearray(n + 2 * width + 1)
    base = np.zeros(len(rows), np.int64)
    low = front = width  # no place before low is free; larger rows are not tried before front
    order = sorted(range(len(rows)), key=lambda s: -len(rows[s]))
    for s in order:
        chars = sorted(rows[s])
        if not chars:
            break
        if len(chars) == 1:
            low = used.find(0, low)
        at, tries = (low if len(chars) == 1 else used.find(0, front)), 0
        while True:
            if at < 0 or at + width >= len(used):
                used.extend(bytes(len(used) + width))
            b = at - chars[0]
            if at >= 0 and not any(used[b + c] for c in chars):
                break
            at, tries = used.find(0, max(at, front) + 1), tries + 1
        if tries > 8:
            front = at - 8
        for c in chars:
            used[b + c] = 1
        base[s] = b
    slots = np.full(len(used) + width, -1, np.int64)
    for s in order:
        for c, to in rows[s].items():
            slots[base[s] + c] = s << 32 | to
    return base, slots[: np.nonzero(slots >= 0)[0].max(initial=0) + width + 1]


class CrossParser:
    """The automata of all languages as one table of transitions, which numpy walks for many texts and all languages
    in step. Characters are numbered without a bound; the table's size follows the samples'."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        norm = {k: normalise(v) for k, v in samples.items()}
        chars = np.unique(np.concatenate([*norm.values(), np.array([32], np.uint32)]))
        self.code_of = np.zeros(sys.maxunicode + 1, np.int32)  # 0: a character that no sample has
        self.code_of[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.bits = np.array([np.log2(len(norm[k]) + 1) for k in self.langs])  # what a phrase of the sample costs to name
        rows: list[dict[int, int]] = []
        roots = []
        self.restart = np.zeros((len(self.langs), self.width), np.int64)
        for j, k in enumerate(self.langs):
            nxt, root = suffix_automaton(self.code_of[norm[k]].tolist()), len(rows)
            roots.append(root)
            # after a failed step the character starts the next phrase
            self.restart[j] = root
            self.restart[j, list(nxt[0])] = root + np.array(list(nxt[0].values()), np.int64)
            rows += [{c: root + to for c, to in d.items()} for d in nxt]
        self.roots = np.array(roots, np.int64)
        self.base, self.slots = displaced(rows, self.width)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.code_of, self.restart, self.base, self.slots))

    def _step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States [language, lane] after a character in each lane, and whether it closed a phrase."""
        found = self.slots[self.base[state] + codes]
        closed = (found >> 32) != state
        return np.where(closed, self.restart[:, codes], found & 0xFFFFFFFF), closed

    def _walk(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, record: int, late_from: int) -> tuple[np.ndarray, ...]:
        """Phrases closed by lanes that all begin at the root, and by what their end closes; and of the first steps and
        of those from late_from on, as many as record, the states and the phrases closed until then."""
        n_lang, n = len(self.langs), len(start)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state = np.repeat(self.roots[:, None], n, 1)
        closed = np.zeros((n_lang, n), np.int64)
        marks = [(np.full((record, n_lang, n), -1, np.int32), np.zeros((record, n_lang, n), np.int32)) for _ in range(2)]
        before_late = np.zeros((n_lang, n), np.int64)
        alive = n
        for i in range(int(size[0]) if n else 0):
            while size[alive - 1] <= i:
                alive -= 1
            if record and i == late_from:
                before_late[:, :alive] = closed[:, :alive]
            new, ends = self._step(state[:, :alive], flat[start[:alive] + i])
            state[:, :alive] = new
            closed[:, :alive] += ends
            for first, (states, counts) in zip((0, late_from), marks):
                if 0 <= i - first < record:
                    states[i - first, :, :alive] = new
                    counts[i - first, :, :alive] = closed[:, :alive] - (before_late[:, :alive] if first else 0)
        at_end = state != self.roots[:, None]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        (early, early_n), (late, late_n) = ([m[:, :, back] for m in mark] for mark in marks)
        return closed[:, back], at_end[:, back], before_late[:, back], early, early_n, late, late_n

    def phrases(self, texts: list[np.ndarray], segment: int = 4096, overlap: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts [text, language] and lengths of normalised texts.

        Texts longer than a segment are walked in segments side by side, each past its end until its phrases fall
        together with those of the next one; what that had counted before is then replaced. A text in which they do
        not within the overlap is walked in one go, so the counts are those of whole texts in every case.
        """
        lens = np.array([len(t) for t in texts], np.int64)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        if not len(self.langs) or not lens.sum():
            return counts, lens
        flat = self.code_of[np.concatenate(texts)]
        begin = np.cumsum(lens) - lens
        segment = max(segment, int(lens.max()) // 1024)  # so that what is recorded of a very long text stays small
        short = np.nonzero(lens <= segment)[0]
        closed, at_end, *_ = self._walk(flat, begin[short], lens[short], 0, 0)
        counts[short] = (closed + at_end).T
        long = np.nonzero(lens > segment)[0]
        if not len(long):
            return counts, lens
        n_seg = -(-lens[long] // segment)
        text = np.repeat(long, n_seg)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        has_next = k + 1 < np.repeat(n_seg, n_seg)
        size = np.minimum(lens[text] - k * segment, segment + overlap * has_next)
        closed, at_end, before_late, early, early_n, late, late_n = self._walk(flat, begin[text] + k * segment, size, overlap, segment)
        whole = np.where(has_next, before_late, closed + at_end)
        lane = np.nonzero(has_next)[0]
        same = (late[:, :, lane] == early[:, :, lane + 1]) & (early[:, :, lane + 1] >= 0)
        j = same.argmax(0)
        lang, pos = np.indices(j.shape)
        whole[:, lane] += late_n[j, lang, lane[pos]]
        whole[:, lane + 1] -= early_n[j, lang, lane[pos] + 1]
        for x in range(len(self.langs)):
            counts[long, x] = np.bincount(text, whole[x], len(texts))[long]
        for t in np.unique(text[lane[~same.any(0).all(0)]]):
            closed, at_end, *_ = self._walk(flat, begin[t : t + 1], lens[t : t + 1], 0, 0)
            counts[t] = (closed + at_end)[:, 0]
        return counts, lens

    def predict(self, texts: list[str | None], batch_chars: int = 1 << 22) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        part: list[np.ndarray] = []
        size = 0
        for t in texts:
            x = normalise(t or "")
            part.append(x if (x != 32).any() else x[:0])
            size += len(x) * max(len(self.langs), 4) // 4
            if size >= batch_chars:
                out += self._predict(part)
                part, size = [], 0
        return out + self._predict(part)

    def _predict(self, part: list[np.ndarray]) -> list[tuple[str, float]]:
        if not part:
            return []
        if not self.langs:
            return [(UNDETERMINED, 0.0)] * len(part)
        counts, lens = self.phrases(part)
        cost = counts * self.bits  # a sample's phrases get longer with its size, by about its logarithm
        best = cost.argmin(1)  # of equal costs the first language by name
        least = cost.min(1)
        rest = cost.copy()
        rest[np.arange(len(part)), best] = np.inf
        second = rest.min(1) if len(self.langs) > 1 else np.maximum(lens, 1) * self.bits[0]
        score = 1 - least / np.maximum(np.maximum(second, least), 1e-9)
        return [(self.langs[b], float(s)) if n else (UNDETERMINED, 0.0) for b, s, n in zip(best, score, lens)]


def training_rows(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Rows that may be learned from: their doc_id's crc32 is not 0 modulo folds, lang and text are there."""
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit(docs: DataFrame, chars_per_lang: int = 40_000, docs_per_lang: int = 200, chars_per_doc: int = 1_000, total_chars: int = 4_000_000) -> CrossParser:
    """Learn from a sample bounded by the four parameters: of each language the docs_per_lang different rows that come first
    by a hash of doc_id give chars_per_doc characters each, up to chars_per_lang, or an equal share of total_chars where
    there are many languages. The table grows by some 50 bytes for each character, so total_chars bounds the
    broadcast at about 200 MB. Where a language's share would be below chars_per_doc, those with the most labelled rows
    are learned, total_chars / chars_per_doc at most."""
    most = total_chars // chars_per_doc
    labelled = training_rows(docs)
    langs = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    counts = {r["lang"]: r["n"] for r in langs.collect()}
    share = min(chars_per_lang, total_chars // max(len(counts), 1))
    # of each language rows of small hashes, some times as many as are asked for, so that few keys are sorted; copies count once
    few = F.broadcast(docs.sparkSession.createDataFrame([(x, min(1.0, 16 * docs_per_lang / n)) for x, n in counts.items()] or [("", 0.0)], "lang string, few double"))
    key = [F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t")]
    keys = labelled.select("lang", "doc_id", *key).join(few, "lang").where(F.col("_h") / 2.0**64 + 0.5 <= F.col("few")).select("lang", "doc_id", "_h", "_t").distinct()
    keys = keys.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "_t"))).where(F.col("_r") <= docs_per_lang).select("lang", "_h", "_t", "_r")
    met = docs.select("lang", *key, F.substring("text", 1, chars_per_doc).alias("t")).join(F.broadcast(keys), ["lang", "_h", "_t"])
    found = met.groupBy("lang", "_r").agg(F.first("t").alias("t"))
    before = F.coalesce(F.sum(F.char_length("t") + 1).over(Window.partitionBy("lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    samples: dict[str, str] = {}
    for r in sorted(found.withColumn("before", before).where(F.col("before") < share).select("lang", "_r", "t").collect()):
        samples[r["lang"]] = (samples.get(r["lang"], "") + " " + r["t"])[:share]
    return CrossParser({k: v for k, v in samples.items() if any(c.isalpha() for c in v)})


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """doc_id, lang_pred and score (1 - least cost / second least, 0 to 1) of every whole text.

    und with score 0 where the text is null or has no letter. Ties go to the language first by name. Repeated
    rows are predicted each; other columns are ignored; an empty table gives an empty result. The parser is
    broadcast; fit bounds its size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            got = p.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
