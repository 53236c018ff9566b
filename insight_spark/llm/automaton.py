"""Several regular expressions as one deterministic automaton over bytes.

The patterns are made into one non-deterministic automaton, that into a
deterministic one by subset construction, and that is minimised. The result is
a transition array and a byte-to-class array, which scan a whole block of text
in one pass for all patterns.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Never a byte of UTF-8: it stands between two texts and ends every match.
SEPARATOR = 0xFF
LANE = 512


class Automaton(NamedTuple):
    table: np.ndarray  # uint16, [state * classes + class] -> state; state 0 is the start
    classes: np.ndarray  # uint8, byte -> class
    accepts: np.ndarray  # int64, state -> bit set of the patterns that end here
    first_accepting: int  # states from here on accept something

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1


def _folded(byte: int, fold: bool) -> int:
    bits = 1 << byte
    if fold and chr(byte).isascii() and chr(byte).isalpha():
        bits |= 1 << (byte ^ 0x20)
    return bits


class Repeat(NamedTuple):
    tree: list
    low: int
    high: int | None  # None: no limit


class Branch(NamedTuple):
    trees: list[list]


class _Parser:
    """The small expression syntax of scan patterns: characters, ``\\xHH`` and escaped signs, sets with ranges,
    groups, alternatives, and the repeats ``? * + {m} {m,} {m,n}``. The tree is a list of byte sets (as bits of
    an integer), branches and repeats."""

    def __init__(self, pattern: str, fold: bool):
        self.pattern, self.fold, self.at = pattern, fold, 0

    def parse(self) -> list:
        tree = self._alternatives()
        if self.at < len(self.pattern):
            raise ValueError(f"unexpected {self.pattern[self.at]} in scan pattern")
        return tree

    def _peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def _take(self) -> str:
        if self.at >= len(self.pattern):
            raise ValueError("scan pattern ends too early")
        self.at += 1
        return self.pattern[self.at - 1]

    def _alternatives(self) -> list:
        trees = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            trees.append(self._sequence())
        return trees[0] if len(trees) == 1 else [Branch(trees)]

    def _sequence(self) -> list:
        tree: list = []
        while self._peek() not in ("", "|", ")"):
            sign = self._take()
            if sign == "(":
                if self._peek() == "?":
                    raise ValueError("not supported in a scan pattern: (?")
                part = self._alternatives()
                if self._take() != ")":
                    raise ValueError("unclosed group in scan pattern")
            elif sign == "[":
                part = [self._set()]
            elif sign in ".^$*+?{":
                raise ValueError(f"not supported in a scan pattern: {sign}")
            else:
                part = [_folded(self._byte(sign), self.fold)]
            tree += self._repeated(part)
        return tree

    def _byte(self, sign: str) -> int:
        if sign == "\\":
            sign = self._take()
            if sign == "x":
                return int(self._take() + self._take(), 16)
            if sign.isalnum():
                raise ValueError(f"not supported in a scan pattern: \\{sign}")
        if ord(sign) > 255:
            raise ValueError("scan patterns match ASCII only")
        return ord(sign)

    def _set(self) -> int:
        negate = self._peek() == "^"
        self.at += negate
        bits, first = 0, True
        while first or self._peek() != "]":
            first = False
            low = high = self._byte(self._take())
            if self._peek() == "-" and self.pattern[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self._byte(self._take())
            for byte in range(low, high + 1):
                bits |= _folded(byte, self.fold)
        self.at += 1
        return (1 << 256) - 1 & ~bits if negate else bits

    def _repeated(self, part: list) -> list:
        sign = self._peek()
        if sign in ("?", "*", "+") and sign:
            self.at += 1
            return [Repeat(part, int(sign == "+"), 1 if sign == "?" else None)]
        if sign == "{":
            end = self.pattern.index("}", self.at)
            low, comma, high = self.pattern[self.at + 1 : end].partition(",")
            self.at = end + 1
            return [Repeat(part, int(low), int(high) if high else None if comma else int(low))]
        return part


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: list, start: int) -> int:
        """Adds the parsed pattern from ``start`` on and returns its end."""
        for part in tree:
            if isinstance(part, Branch):
                end = self.state()
                for branch in part.trees:
                    self.empty[self.add(branch, start)].append(end)
                start = end
            elif isinstance(part, Repeat):
                start = self._repeat(part, start)
            else:
                start = self._step(start, part)
        return start

    def _step(self, start: int, byte_set: int) -> int:
        end = self.state()
        self.moves[start].append((byte_set, end))
        return end

    def _repeat(self, part: Repeat, start: int) -> int:
        for _ in range(part.low):
            start = self.add(part.tree, start)
        if part.high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part.tree, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(part.high - part.low):
            start = self.add(part.tree, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


@lru_cache(maxsize=8)
def compile_patterns(patterns: tuple[tuple[str, bool], ...]) -> Automaton:
    """One automaton for all (pattern, ignore ASCII case); it looks for matches that start anywhere."""
    nfa, starts, final = _Nfa(), [], {}
    for bit, (pattern, fold) in enumerate(patterns):
        start = nfa.state()
        starts.append(start)
        final[nfa.add(_Parser(pattern, fold).parse(), start)] = 1 << bit
    sets = [byte_set for moves in nfa.moves for byte_set, _ in moves]
    if any(byte_set >> 128 for byte_set in sets):
        raise ValueError("scan patterns match ASCII only")
    classes = _classes(sets)
    samples = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
    # Sets of states are bit sets; each state knows, per class, the closure it leads to.
    leads: list[list[tuple[int, int]]] = []
    for moves in nfa.moves:
        per_class = [(c, nfa.closure([t for byte_set, t in moves if byte_set >> b & 1])) for c, b in enumerate(samples)]
        leads.append([(c, sum(1 << s for s in states)) for c, states in per_class if states])
    begin = sum(1 << s for s in nfa.closure(starts))
    numbers, order, rows, accepts = {begin: 0}, [begin], [], []
    for states in order:
        row, accept, rest = [begin] * len(samples), 0, states
        while rest:
            lowest = rest & -rest
            rest ^= lowest
            state = lowest.bit_length() - 1
            accept |= final.get(state, 0)
            for c, targets in leads[state]:
                row[c] |= targets
        for after in row:
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
        rows.append([numbers[after] for after in row])
        accepts.append(accept)
    return _minimised(np.array(rows), np.array(accepts, np.int64), classes)


def _classes(byte_sets: list[int]) -> np.ndarray:
    """Bytes that no pattern tells apart share a class; the separator's class kills every match."""
    signatures: dict[tuple, int] = {}
    distinct = list(dict.fromkeys(byte_sets))
    out = np.zeros(256, np.uint8)
    for byte in range(256):
        if byte == SEPARATOR:
            key = tuple(0 for _ in distinct)
        else:
            key = tuple(s >> byte & 1 for s in distinct)
        out[byte] = signatures.setdefault(key, len(signatures))
    return out


def _minimised(rows: np.ndarray, accepts: np.ndarray, classes: np.ndarray) -> Automaton:
    """Moore's refinement; the start becomes state 0 and accepting states come last.

    A round tells states apart by a 64-bit hash of their group and their
    successors' groups; the outcome is verified against the rows.
    """
    _, group = np.unique(accepts, return_inverse=True)
    mix = np.random.default_rng(0).integers(1, 1 << 63, (2, max(rows.shape) + 1), np.uint64)
    while True:
        codes = mix[0, group]
        key = codes.copy()
        for column in range(rows.shape[1]):
            key += codes[rows[:, column]] * mix[1, column]
        _, finer = np.unique(key, return_inverse=True)
        if finer.max() == group.max():
            break
        group = finer
    count = int(group.max()) + 1
    member = np.zeros(count, np.int64)
    member[group[::-1]] = np.arange(len(group))[::-1]
    if (accepts != accepts[member[group]]).any() or (group[rows] != group[rows[member[group]]]).any():
        raise RuntimeError("states of different behaviour were merged")
    start = group[0]
    rank = sorted(range(count), key=lambda g: (g != start, bool(accepts[member[g]]), int(member[g])))
    place = np.empty(count, np.int64)
    place[rank] = np.arange(count)
    if count > 0xFFFF:
        raise ValueError("too many states")
    kept = member[rank]
    table = place[group[rows[kept]]].astype(np.uint16)
    accepting = accepts[kept]
    first = int(np.argmax(accepting != 0)) if accepting.any() else count
    return Automaton(np.ascontiguousarray(table.reshape(-1)), classes, accepting, first)


def scan(automaton: Automaton, data: bytes) -> np.ndarray:
    """The state after each byte of ``data``, which must end with the separator.

    The block is cut into lanes that advance together, each from the start
    state. A lane whose predecessor ends in another state is run again, only
    until both runs agree, and so on until every lane has its right entry.
    """
    width, table = automaton.width, automaton.table
    size = len(data)
    lanes = max(1, -(-size // LANE))
    padded = np.full(lanes * LANE, SEPARATOR, np.uint8)
    padded[:size] = np.frombuffer(data, np.uint8)
    columns = np.ascontiguousarray(automaton.classes[padded].reshape(lanes, LANE).T)
    del padded
    states = np.empty((LANE, lanes), np.uint16)
    index = np.zeros(lanes, np.int32)
    for t in range(LANE):
        if t:
            np.multiply(states[t - 1], width, out=index, dtype=np.int32, casting="unsafe")
        index += columns[t]
        np.take(table, index, out=states[t], mode="clip")
    entered = np.zeros(lanes, np.uint16)
    while True:
        entry = np.concatenate((np.zeros(1, np.uint16), states[-1, :-1]))
        open_lanes = np.flatnonzero(entry != entered)
        if not len(open_lanes):
            break
        entered[open_lanes] = current = entry[open_lanes]
        for t in range(LANE):
            now = table[current.astype(np.int32) * width + columns[t, open_lanes]]
            differs = now != states[t, open_lanes]
            open_lanes, current = open_lanes[differs], now[differs]
            if not len(open_lanes):
                break
            states[t, open_lanes] = current
    return np.ascontiguousarray(states.T).reshape(-1)[:size]


def compiled(pattern: str, fold: bool) -> re.Pattern:
    """The same pattern for Python's matcher, with ASCII letters alone folded."""
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if fold else 0))
