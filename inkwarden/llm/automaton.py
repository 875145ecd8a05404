"""Byte automata: a small regular-expression compiler and a lockstep scanner.

Expressions are compiled to a Thompson automaton over bytes, made deterministic
by subset construction, minimised by partition refinement, and kept as one flat
transition array. Supported syntax: literals, ``\\xHH``, escapes, classes,
groups, ``|``, ``?``, ``*``, ``+``, ``{n}`` and ``{n,}``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a scan lane.
LANE = 1024


def _byte(p: str, i: int) -> tuple[int, int]:
    """The byte written at i, and where the next begins."""
    if p[i] != "\\":
        return ord(p[i]), i + 1
    if p[i + 1] == "x":
        return int(p[i + 2 : i + 4], 16), i + 4
    return ord({"n": "\n", "t": "\t", "r": "\r"}.get(p[i + 1], p[i + 1])), i + 2


class _Nfa:
    """Thompson automaton; each parse returns (entry, exit) states."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def compile(self, pattern: str, backwards: bool = False) -> tuple[int, int]:
        tree, end = self._either(pattern, 0)
        if end != len(pattern):
            raise ValueError(f"unbalanced ) at {end} in {pattern!r}")
        return self._build(self._mirrored(tree) if backwards else tree)

    def _mirrored(self, tree):
        """The tree that matches the same strings read from their ends."""
        if tree[0] in ("all", "either"):
            items = [self._mirrored(t) for t in tree[1]]
            return (tree[0], items[::-1] if tree[0] == "all" else items)
        return tree if tree[0] == "set" else (tree[0], self._mirrored(tree[1]), *tree[2:])

    def _either(self, p: str, i: int):
        options, items = [], []
        while i < len(p) and p[i] != ")":
            if p[i] == "|":
                options.append(("all", items))
                items, i = [], i + 1
                continue
            if p[i] == "(":
                item, i = self._either(p, i + (3 if p.startswith("(?:", i) else 1))
                i += 1
            elif p[i] == "[":
                item, i = self._class(p, i + 1)
            else:
                value, i = _byte(p, i)
                item = ("set", frozenset([value]))
            while i < len(p) and p[i] in "?*+{":
                if p[i] == "{":
                    close = p.index("}", i)
                    low, comma, high = p[i + 1 : close].partition(",")
                    if high:
                        raise ValueError("an upper bound of a repetition is not supported")
                    item, i = ("repeat", item, int(low), bool(comma)), close + 1
                else:
                    item, i = {"?": ("maybe", item), "*": ("repeat", item, 0, True), "+": ("repeat", item, 1, True)}[p[i]], i + 1
            items.append(item)
        return ("either", [*options, ("all", items)]), i

    def _class(self, p: str, i: int):
        negated, members = p[i] == "^", set()
        i += negated
        while p[i] != "]":
            low, i = _byte(p, i)
            high = low
            if p[i] == "-" and p[i + 1] != "]":
                high, i = _byte(p, i + 1)
            members |= set(range(low, high + 1))
        return ("set", frozenset(set(range(256)) - members if negated else members)), i + 1

    def _build(self, tree) -> tuple[int, int]:
        kind, start = tree[0], self.state()
        if kind == "set":
            end = self.state()
            self.move[start] = (tree[1], end)
            return start, end
        if kind == "all":
            at = start
            for item in tree[1]:
                a, b = self._build(item)
                self.empty[at].append(a)
                at = b
            return start, at
        end = self.state()
        if kind in ("either", "maybe"):
            for item in tree[1] if kind == "either" else [tree[1]]:
                a, b = self._build(item)
                self.empty[start].append(a)
                self.empty[b].append(end)
            if kind == "maybe":
                self.empty[start].append(end)
            return start, end
        _, item, low, more = tree
        at = start
        for _ in range(low):
            a, b = self._build(item)
            self.empty[at].append(a)
            at = b
        if more:
            a, b = self._build(item)
            self.empty[at].append(a)
            self.empty[b].append(at)
        self.empty[at].append(end)
        return start, end


@dataclass(frozen=True)
class Dfa:
    """Rows of ``step`` are states; accepting states come last."""

    classes: np.ndarray  #: byte -> column
    step: np.ndarray  #: state, column -> state
    accepts: np.ndarray  #: state -> bit mask of the rules that end here
    start: int
    dead: int  #: the state that nothing leaves, -1 if there is none

    @property
    def first_accept(self) -> int:
        return int(np.searchsorted(self.accepts > 0, True))


def determinise(patterns: list[str], anchored: bool, backwards: bool = False) -> Dfa:
    """One minimal automaton for all patterns; unanchored ones may begin anywhere, backwards ones read from the end."""
    nfa, entries, finals = _Nfa(), [], {}
    for bit, pattern in enumerate(patterns):
        a, b = nfa.compile(pattern, backwards)
        entries.append(a)
        finals[b] = finals.get(b, 0) | 1 << bit
    sets = sorted({m[0] for m in nfa.move if m}, key=sorted)
    kinds = np.unique(np.array([[b in s for s in sets] for b in range(256)], bool), axis=0, return_inverse=True)
    classes = kinds[1].reshape(-1).astype(np.uint8)
    sample = [int(np.argmax(classes == c)) for c in range(len(kinds[0]))]

    closures: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closures:
            seen, todo = {state}, [state]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closures[state] = frozenset(s for s in seen if nfa.move[s] or s in finals)
        return closures[state]

    begin = frozenset().union(*(closure(e) for e in entries))
    numbers, order, rows = {begin: 0}, [begin], []
    for here in order:  # grows meanwhile
        row = []
        for byte in sample:
            there = set() if anchored else set(begin)
            for s in here:
                if (m := nfa.move[s]) and byte in m[0]:
                    there |= closure(m[1])
            key = frozenset(there)
            if key not in numbers:
                numbers[key] = len(order)
                order.append(key)
            row.append(numbers[key])
        rows.append(row)
    step = np.array(rows, np.int64)
    accepts = np.array([sum({finals[s] for s in states if s in finals}) for states in order], np.int64)

    label = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([label, label[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    count = int(label.max()) + 1
    some = np.zeros(count, np.int64)
    some[label] = np.arange(len(label))
    rank = np.empty(count, np.int64)
    rank[np.argsort(accepts[some], kind="stable")] = np.arange(count)
    minimal, masks = np.empty((count, step.shape[1]), np.int64), np.empty(count, np.int64)
    minimal[rank], masks[rank] = rank[label[step[some]]], accepts[some]
    start = int(rank[label[0]])
    stuck = [s for s in range(count) if not masks[s] and (minimal[s] == s).all()]
    return Dfa(classes, minimal.astype(np.int32), masks, start, stuck[0] if stuck and anchored else -1)


def lanes_of(bounds: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Starts of lanes, and which of them begin a text: texts, cut every so many bytes."""
    counts = -(-np.diff(bounds) // lane)
    first = np.repeat(bounds[:-1], counts)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first + nth * lane, nth == 0


def scan(dfa: Dfa, data: np.ndarray, bounds: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(place, rule mask) wherever a match of some rule ends, in order; place is the byte's, the texts lie between bounds.

    One pass over all bytes, lanes in lockstep, each from the start state. A lane within a text really begins in
    the state that its left neighbour ended in, so from there it is read once more, beside the run from the start,
    until both are in one state: a few bytes as a rule, and as far as a match reaches at most.
    """
    starts, leads = lanes_of(bounds, lane)
    ends = np.append(starts[1:], bounds[-1:])
    width = dfa.step.shape[1]
    flat = (dfa.step * width).reshape(-1).astype(np.int32)
    columns = dfa.classes[data]
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    position, lengths = starts[order].copy(), lengths[order]
    state = np.full(len(order), dfa.start * width, np.int32)
    places, masks, limit = [], [], dfa.first_accept * width
    active = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1 if len(lengths) else 1), side="right")
    for n in active:
        here = flat[state[:n] + columns[position[:n]]]
        state[:n] = here
        if int(here.max()) >= limit:
            at = np.flatnonzero(here >= limit)
            places.append(position[at])
            masks.append(dfa.accepts[here[at] // width])
        position[:n] += 1
    last = np.empty(len(order), np.int64)
    last[order] = state // width
    more = _carried(dfa, columns, starts, ends, leads, last)
    places, masks = np.concatenate([*places, more[0]]).astype(np.int64), np.concatenate([*masks, more[1]]).astype(np.int64)
    by = np.argsort(places, kind="stable")
    return places[by], masks[by]


def _carried(dfa: Dfa, columns: np.ndarray, starts: np.ndarray, ends: np.ndarray, leads: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
    """What ends in a lane only because of what its left neighbours read."""
    step, accepts, begin = dfa.step.tolist(), dfa.accepts.tolist(), dfa.start
    places: list[int] = []
    masks: list[int] = []
    state = begin
    for lead, a, b, end in zip(leads.tolist(), starts.tolist(), ends.tolist(), last.tolist(), strict=True):
        if lead or state == begin:
            state = end
            continue
        plain = begin
        for at, column in enumerate(columns[a:b].tolist(), a):
            plain, state = step[plain][column], step[state][column]
            if plain == state:
                state = end
                break
            if accepts[state] & ~accepts[plain]:
                places.append(at)
                masks.append(accepts[state] & ~accepts[plain])
    return places, masks
