"""Many regular expressions as one deterministic automaton over bytes, and texts scanned by it.

The rules' expressions become positions and what may follow them; the automaton of all rules read backwards, found by
subset construction, tells at each byte which rules have a match that starts there. Equal states are merged and bytes
that no rule tells apart share a column, so a scan is one lookup in an integer array for each byte.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from re import IGNORECASE, _constants as ops, _parser

import numpy as np

#: Stands between texts: a byte that UTF-8 never holds, after which no rule goes on.
BREAK = 0xFF
LANE = 256


@dataclass(frozen=True)
class Rule:
    """A kind of match: a head and then a value of at least `least` code points. The head takes the longest match, and
    so does the value after it. A match too short is dropped and what it covers is not tried again."""

    kind: str
    head: str
    value: str
    least: int = 1


class Positions:
    """Byte classes of the positions of regular expressions, with those that follow each."""

    def __init__(self) -> None:
        self.classes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def add(self, regex: str) -> tuple[bool, set[int], set[int]]:
        """Whether the expression matches nothing at all, its first positions and its last ones."""
        tree = _parser.parse(regex)
        return self._sequence(tree, tree.state.flags)

    def _leaf(self, chars: frozenset[int]) -> tuple[bool, set[int], set[int]]:
        self.classes.append(chars)
        self.follow.append(set())
        return False, {len(self.classes) - 1}, {len(self.classes) - 1}

    def _join(self, a: tuple, b: tuple) -> tuple[bool, set[int], set[int]]:
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def _sequence(self, items, flags: int) -> tuple[bool, set[int], set[int]]:
        out = (True, set(), set())
        for item in items:
            out = self._join(out, self._one(*item, flags))
        return out

    def _one(self, op, arg, flags: int) -> tuple[bool, set[int], set[int]]:
        if op in (ops.LITERAL, ops.IN):
            items = arg if op is ops.IN else [(op, arg)]
            if op is ops.LITERAL and arg > 127:
                out = (True, set(), set())
                for b in chr(arg).encode():
                    out = self._join(out, self._leaf(frozenset([b])))
                return out
            return self._leaf(self._chars(items, flags))
        if op is ops.SUBPATTERN:
            return self._sequence(arg[3], (flags | arg[1]) & ~arg[2])
        if op is ops.BRANCH:
            parts = [self._sequence(x, flags) for x in arg[1]]
            return any(x[0] for x in parts), set().union(*(x[1] for x in parts)), set().union(*(x[2] for x in parts))
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            low, high, item = arg
            out = (True, set(), set())
            endless = high is ops.MAXREPEAT
            for i in range(max(low, 1) if endless else high):
                one = self._sequence(item, flags)
                if endless and i == max(low, 1) - 1:
                    self._join(one, one)
                out = self._join(out, (one[0] or i >= low, one[1], one[2]))
            return out
        raise ValueError(f"{op} has no automaton here")

    @staticmethod
    def _chars(items, flags: int) -> frozenset[int]:
        got: set[int] = set()
        for op, arg in items:
            if op is ops.LITERAL:
                got.add(arg)
            elif op is ops.RANGE:
                got.update(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"{op} has no automaton here")
        if flags & IGNORECASE:
            got |= {ord(c) for x in got for c in (chr(x).lower(), chr(x).upper()) if len(c) == 1}
        if max(got, default=0) > 127:
            raise ValueError("a class of characters beyond ASCII has no automaton here")
        return frozenset(got)


@dataclass(frozen=True)
class Automaton:
    """table[state * width + column of a byte] is the next state; marks[state] has bit r if rule r is met in the state.
    State 0 is the first one."""

    column: np.ndarray
    table: np.ndarray
    marks: np.ndarray
    width: int

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int], int]:
        """The same for steps byte by byte."""
        return self.column.tolist(), self.table.tolist(), self.marks.tolist(), self.width


def determined(classes: list[frozenset[int]], first: set[int], follow: list[set[int]], done: dict[int, int], restart: bool, empty: int = 0) -> Automaton:
    """Subset construction and minimisation. done: position -> bits that it marks; restart: matches may begin anywhere;
    empty: what the first state marks."""
    kinds: dict[tuple, int] = {}
    column = np.zeros(256, np.int32)
    for b in range(256):
        column[b] = kinds.setdefault(tuple(i for i, c in enumerate(classes) if b in c), len(kinds))
    width = len(kinds)
    members = [set(k) for k in kinds]
    start: tuple[frozenset[int], bool] = (frozenset(), True)
    numbers, queue, table = {start: 0}, [start], []
    for here, fresh in queue:
        reach = set().union(first if fresh or restart else (), *(follow[p] for p in here))
        for k in range(width):
            to = (frozenset(reach & members[k]), restart)
            if to not in numbers:
                numbers[to] = len(numbers)
                queue.append(to)
            table.append(numbers[to])
    moves = np.array(table, np.int64).reshape(-1, width)
    marks = np.zeros(len(numbers), np.int64)
    marks[0] = empty
    for (here, _), i in numbers.items():
        for p in here:
            marks[i] |= done.get(p, 0)
    # states fall into classes by what they mark, then by the classes that they lead to, until no class splits
    group = np.unique(marks, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = {}
    for g in group.tolist():
        order.setdefault(g, len(order))
    group = np.array([order[g] for g in group.tolist()])
    keep = np.unique(group, return_index=True)[1]
    return Automaton(column, group[moves[keep]].astype(np.int32).ravel(), marks[keep], width)


@dataclass(frozen=True)
class Scanner:
    """What scan() needs: the automaton of all rules backwards, and of each rule's head and value forwards."""

    rules: tuple[Rule, ...]
    back: Automaton
    heads: tuple[Automaton | None, ...]
    values: tuple[Automaton, ...]


def _forward(regex: str) -> Automaton:
    p = Positions()
    nothing, first, last = p.add(regex)
    return determined(p.classes, first, p.follow, {x: 1 for x in last}, restart=False, empty=int(nothing))


def compile_rules(rules: tuple[Rule, ...]) -> Scanner:
    p, ends, done = Positions(), set(), {}
    for r, rule in enumerate(rules):
        head = p.add(rule.head) if rule.head else (True, set(), set())
        value = p.add(rule.value)
        nothing, first, last = p._join(head, value)
        if nothing or value[0]:
            raise ValueError(f"{rule.kind} matches an empty value")
        ends |= last
        for x in first:
            done[x] = done.get(x, 0) | 1 << r
    before: list[set[int]] = [set() for _ in p.classes]
    for x, after in enumerate(p.follow):
        for y in after:
            before[y].add(x)
    back = determined(p.classes, ends, before, done, restart=True)
    return Scanner(rules, back, tuple(_forward(r.head) if r.head else None for r in rules), tuple(_forward(r.value) for r in rules))


def states(auto: Automaton, data: np.ndarray) -> np.ndarray:
    """State after each byte, read from the last one backwards; data is a multiple of LANE bytes long.

    Lanes of LANE bytes are read side by side, each as if nothing stood behind it. Where the lane behind ends in
    another state than that, the lane is read again from there until it comes to a state that it was in before, and so
    on to the next one; few lanes are read byte by byte.
    """
    table, width = auto.table, auto.width
    cols = np.ascontiguousarray(auto.column[data].reshape(-1, LANE).T)
    got = np.empty_like(cols)
    at = np.zeros(cols.shape[1], np.int32)
    for t in range(LANE - 1, -1, -1):
        at = table[at * width + cols[t]]
        got[t] = at
    lanes = np.flatnonzero(got[0, 1:])
    while len(lanes) > 16:
        at, live = got[0, lanes + 1], lanes
        for t in range(LANE - 1, -1, -1):
            at = table[at * width + cols[t, live]]
            other = at != got[t, live]
            at, live = at[other], live[other]
            if not len(live):
                break
            got[t, live] = at
        lanes = live[live > 0] - 1
    got = np.ascontiguousarray(got.T).ravel()
    column, table, _, width = auto.lists
    for lane in lanes[::-1].tolist():
        s = int(got[(lane + 1) * LANE])
        for k in range(lane * LANE + LANE - 1, -1, -1):
            s = table[s * width + column[data[k]]]
            if s == got[k]:
                break
            got[k] = s
    return got


def longest(auto: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that begins at a byte; -1 without one."""
    column, table, marks, width = auto.lists
    s, end = 0, at if marks[0] else -1
    dead = table[column[BREAK]]
    for i in range(at, len(data)):
        s = table[s * width + column[data[i]]]
        if s == dead:
            break
        if marks[s]:
            end = i + 1
    return end


def scan(scanner: Scanner, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """For every text the matches of all rules as (start, end, rule) in bytes, by start and rule: for each rule the
    leftmost first, none overlapping another, those too short dropped."""
    data = bytes([BREAK]).join(texts) + bytes([BREAK])
    padded = np.frombuffer(data + bytes([BREAK]) * (-len(data) % LANE), np.uint8)
    met = scanner.back.marks[states(scanner.back, padded)]
    places = np.flatnonzero(met)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(places):
        return out
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    for r, rule in enumerate(scanner.rules):
        own = places[met[places] >> r & 1 == 1]
        i = 0
        while i < len(own):
            s = int(own[i])
            h = longest(scanner.heads[r], data, s) if scanner.heads[r] is not None else s
            e = longest(scanner.values[r], data, h) if h >= 0 else -1
            if e < 0:  # the longest head leaves no value
                i += 1
                continue
            if len(data[h:e].decode(errors="replace")) >= rule.least:
                d = int(np.searchsorted(starts, s, "right")) - 1
                out[d].append((s - int(starts[d]), e - int(starts[d]), r))
            i = int(np.searchsorted(own, e))
    return [sorted(x, key=lambda m: (m[0], m[2])) for x in out]
