"""Many regular expressions as one minimised deterministic automaton over bytes.

``compile_rules`` parses each expression, joins their position automata under
one start state that may begin anew at every byte, applies the subset
construction and merges equivalent states. The result is a transition array
over classes of bytes. ``scan`` drives it over many texts at once and tells
where matches end; of automata that are turned to read backward, and texts in
reverse, these are the places where matches begin. ``longest`` drives an
anchored one from there to the end of the longest match.

The expressions use literals, escapes (\\xHH, \\d, \\s and escaped
punctuation), ``.``, ``[...]``, groups, ``|`` and ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .common import ranges

_ALL = frozenset(range(256))
_SETS = {"d": frozenset(b"0123456789"), "s": frozenset(b" \t\n\r\x0b\x0c")}
#: Bytes of a text that one lane reads, and those before it from which its state is guessed.
SEGMENT, WARM = 512, 24
#: Fewer segments than this to run again go one after the other, not side by side.
FEW = 32


class _Builder:
    """Thompson fragments (first, last) over shared edge lists."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.byte: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.byte.append(None)
        return len(self.empty) - 1

    def parse(self, rule: str) -> tuple[int, int]:
        self.text, self.at = rule, 0
        found = self.either()
        if self.at != len(rule):
            raise ValueError(f"unbalanced expression: {rule}")
        return found

    def turn(self) -> None:
        """Turn all edges; a state has one byte edge at most, also from behind."""
        empty, byte = self.empty, self.byte
        self.empty, self.byte = [[] for _ in empty], [None] * len(byte)
        for s, targets in enumerate(empty):
            for t in targets:
                self.empty[t].append(s)
        for s, edge in enumerate(byte):
            if edge:
                self.byte[edge[1]] = (edge[0], s)

    def either(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.empty[first].append(a)
            self.empty[b].append(last)
            if self.text[self.at : self.at + 1] != "|":
                return first, last
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin = self.at
            piece = self.atom()
            end = self.at
            low, high = self.count()
            after = self.at
            for k in range(max(low, high if high is not None else low + 1) or 1):
                if k:
                    self.at = begin
                    piece = self.atom()
                    assert self.at == end
                a, b = piece
                if high is None and k == low or high is not None and k >= low:
                    self.empty[last].append(a)
                    skip = self.state()
                    self.empty[last].append(skip)
                    self.empty[b].append(skip)
                    if high is None:
                        self.empty[b].append(a)
                    last = skip
                else:
                    self.empty[last].append(a)
                    last = b
            self.at = after
        return first, last

    def count(self) -> tuple[int, int | None]:
        c = self.text[self.at : self.at + 1]
        if c in ("?", "*", "+"):
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            found = self.either()
            self.at += 1
            return found
        if c == "[":
            held = self.held()
        elif c == "\\":
            held = self.escape()
        else:
            held = _ALL if c == "." else frozenset(c.encode("latin-1"))
        first, last = self.state(), self.state()
        self.byte[first] = (held, last)
        return first, last

    def escape(self) -> frozenset[int]:
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return frozenset([int(self.text[self.at - 2 : self.at], 16)])
        return _SETS.get(c) or frozenset(c.encode("latin-1"))

    def held(self) -> frozenset[int]:
        negated = self.text[self.at] == "^"
        self.at += negated
        found: set[int] = set()
        while self.text[self.at] != "]":
            one = self.one()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]" and len(one) == 1:
                self.at += 1
                found |= set(range(min(one), max(self.one()) + 1))
            else:
                found |= one
        self.at += 1
        return _ALL - found if negated else frozenset(found)

    def one(self) -> frozenset[int]:
        c = self.text[self.at]
        self.at += 1
        return self.escape() if c == "\\" else frozenset(c.encode("latin-1"))


@dataclass(frozen=True)
class Automaton:
    """next[s * classes + c]: the next state times classes; accepts[s]: a bit for each rule that a match ends here."""

    next: np.ndarray
    accepts: np.ndarray
    byte_class: np.ndarray
    classes: int

    @property
    def states(self) -> int:
        return len(self.accepts)

    @cached_property
    def masks(self) -> np.ndarray:
        found = np.zeros(self.states * self.classes, np.int64)
        found[:: self.classes] = self.accepts
        return found

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int], int]:
        """next, masks and byte_class as lists, and the state that nothing leaves, or -1."""
        home = np.arange(self.states) * self.classes
        dead = np.flatnonzero((self.next.reshape(self.states, -1) == home[:, None]).all(axis=1) & (self.accepts == 0))
        return self.next.tolist(), self.masks.tolist(), self.byte_class.tolist(), int(home[dead[0]]) if len(dead) else -1


def compile_rules(rules: list[str], backward: bool = False, anchored: bool = False) -> Automaton:
    """The minimal automaton that tells, after each byte, which rules have a match that ends there.

    backward: for texts that are read from their last byte. anchored: of
    matches that begin at the first byte only.
    """
    nfa = _Builder()
    parts = [nfa.parse(rule) for rule in rules]
    if backward:
        nfa.turn()
        parts = [(b, a) for a, b in parts]
    start = nfa.state()
    ends: dict[int, int] = {}
    for k, (first, last) in enumerate(parts):
        nfa.empty[start].append(first)
        ends[last] = 1 << k
    sets = sorted({x[0] for x in nfa.byte if x}, key=sorted)
    keys = np.zeros((256, len(sets)), np.uint8)
    for j, held in enumerate(sets):
        keys[sorted(held), j] = 1
    _, chosen, byte_class = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    byte_class = byte_class.ravel()

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.byte[s] or s in ends)

    root, again = closure({start}), set() if anchored else {start}
    number, order, table = {root: 0}, [root], []
    for states in order:
        row = []
        for b in chosen:
            target = closure(again | {nfa.byte[s][1] for s in states if nfa.byte[s] and b in nfa.byte[s][0]})
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        table.append(row)
    accepts = np.array([sum(ends[s] for s in states if s in ends) for states in order], np.int64)
    moves = np.array(table, np.int64)
    # equivalent states: refine by what the next states are, until nothing splits
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    renumber = {}
    for g in group:
        renumber.setdefault(int(g), len(renumber))
    group = np.array([renumber[int(g)] for g in group])
    _, first = np.unique(group, return_index=True)
    classes = len(chosen)
    return Automaton((group[moves[first]] * classes).astype(np.int32).ravel(), accepts[first], byte_class.astype(np.uint8), classes)


def longest(dfa: Automaton, data: bytes, at: int, stop: int) -> int:
    """Where the longest match of an anchored automaton ends that begins at ``at``; -1 if there is none."""
    move, masks, kinds, dead = dfa.lists
    state, end = 0, at if masks[0] else -1
    while at < stop and state != dead:
        state = move[state + kinds[data[at]]]
        at += 1
        if masks[state]:
            end = at
    return end


def scan(dfa: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts data[offsets[i]:offsets[i + 1]] with which matches end, in no order, and the bits of their rules.

    Texts are cut into segments that run side by side. A segment begins in the
    state guessed from the bytes before it; those whose guess differs from the
    state in which the segment before it really ended run again, until none
    differs, so that the result is that of one pass from the first byte.
    """
    length = np.diff(offsets)
    parts = -(-length // SEGMENT)
    doc = np.repeat(np.arange(len(length)), parts)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = ranges(np.zeros(len(length), np.int64), parts) * SEGMENT
    begin = offsets[doc] + inner
    size = np.minimum(SEGMENT, offsets[doc + 1] - begin)
    first = inner == 0
    symbols = dfa.byte_class[data]
    masks = dfa.masks
    # a segment's hits count if they are of its last run
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
    last = np.zeros(len(doc), np.int64)

    def run(which: np.ndarray, state: np.ndarray, at: np.ndarray, size: np.ndarray, number: int) -> np.ndarray:
        order = np.argsort(-size, kind="stable")
        at, left, now = at[order].copy(), size[order], state[order].astype(np.int32)
        active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        for m in active:
            s = dfa.next[now[:m] + symbols[at[:m]]]
            now[:m] = s
            if number:
                bits = masks[s]
                some = np.flatnonzero(bits)
                if len(some):
                    hits.append((which[order[some]], at[some], bits[some], number))
            at[:m] += 1
        last[which] = number
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return now[back]

    def follow(i: int, number: int) -> None:
        """Run segments from i on, until one begins as it was guessed."""
        move, accepts, _, _ = dfa.lists
        while i < len(doc) and not first[i] and state[i] != end[i - 1]:
            s = int(end[i - 1])
            state[i], places, bits = s, [], []
            for j, x in enumerate(symbols[begin[i] : begin[i] + size[i]].tolist(), int(begin[i])):
                s = move[s + x]
                if accepts[s]:
                    places.append(j)
                    bits.append(accepts[s])
            hits.append((np.full(len(places), i), np.array(places, np.int64), np.array(bits, np.int64), number))
            end[i], last[i] = s, number
            i += 1

    state = np.zeros(len(doc), np.int32)
    late = np.flatnonzero(~first)
    if len(late):
        state[late] = run(late, state[late], begin[late] - WARM, np.full(len(late), WARM), 0)
    number = 1
    end = run(np.arange(len(doc)), state, begin, size, number)
    while True:
        wrong = late[state[late] != end[late - 1]]
        if not len(wrong):
            break
        number += 1
        if len(wrong) < FEW:
            for i in wrong.tolist():
                follow(i, number)
            continue
        state[wrong] = end[wrong - 1]
        end[wrong] = run(wrong, state[wrong], begin[wrong], size[wrong], number)
    kept = [(at[ok], bits[ok]) for which, at, bits, k in hits for ok in [last[which] == k] if ok.any()]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])
