"""Regexes to one minimal deterministic automaton over bytes.

A small dialect is parsed (literals, escapes, classes, groups, alternation, ``? * + {m} {m,} {m,n}``),
turned into position automata, combined, made deterministic by subset construction over byte
classes and minimised by partition refinement into one transition array.
"""

from __future__ import annotations

import itertools
import operator
from dataclasses import dataclass

import numpy as np

#: Subset construction gives up beyond this.
MOST_STATES = 20_000
_CLASS = {"d": range(48, 58), "w": [*range(48, 58), *range(65, 91), 95, *range(97, 123)], "s": [9, 10, 11, 12, 13, 32]}


class _Parser:
    """Builds a syntax tree: ("set", frozenset), ("cat", ...), ("alt", ...), ("rep", node, low, high)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self.alternation()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return node

    def alternation(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", *parts)

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def repeat(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                bounds = int(low), (int(high) if high else None) if comma else int(low)
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, *bounds)
        return node

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternation()
            if self.peek() != ")":
                raise ValueError("group not closed")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c == "\\":
            return ("set", self.escape())
        data = c.encode()
        return ("set", frozenset(data)) if len(data) == 1 else ("cat", *(("set", frozenset([b])) for b in data))

    def escape(self) -> frozenset[int]:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        if c in _CLASS:
            return frozenset(_CLASS[c])
        return frozenset([{"n": 10, "t": 9, "r": 13}.get(c, ord(c))])

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            c = self.p[self.i]
            self.i += 1
            low = self.escape() if c == "\\" else frozenset([ord(c)])
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                c = self.p[self.i + 1]
                self.i += 2
                high = self.escape() if c == "\\" else frozenset([ord(c)])
                low = frozenset(range(min(low), max(high) + 1))
            found |= low
        self.i += 1
        return frozenset(range(256)) - found if negated else frozenset(found)


def fold_case(node):
    """The same tree with letters in either case."""
    if node[0] == "set":
        return ("set", node[1] | {b ^ 32 for b in node[1] if chr(b).isalpha() and b < 128})
    return (node[0], *(fold_case(x) if isinstance(x, tuple) else x for x in node[1:]))


def reverse(node):
    if node[0] == "cat":
        return ("cat", *(reverse(x) for x in node[:0:-1]))
    return (node[0], *(reverse(x) if isinstance(x, tuple) else x for x in node[1:]))


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds node after start; returns where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            via = self.state()
            self.empty[start].append(via)
            self.step[via] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1:]:
                start = self.build(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1:]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(x, first)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.build(inner, start)
        self.empty[start].append(end)
        return end


@dataclass
class Dfa:
    """next[state, byte]; accepts[state]: bit r is set where a match of rule r ends; 0 is the start."""

    next: np.ndarray
    accepts: np.ndarray

    def rows(self) -> list[list]:
        """Each state as a list: the following state for each byte, then the accept bits."""
        states: list[list] = [[] for _ in range(len(self.next))]
        for state, row, bits in zip(states, self.next.tolist(), self.accepts.tolist(), strict=True):
            state.extend(states[k] for k in row)
            state.append(bits)
        return states


def compile_rules(trees: list, anywhere: bool) -> Dfa:
    """One automaton for all trees; anywhere: matches may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    final = {}
    for r, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        final[nfa.build(tree, first)] = r

    closures: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in closures:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closures[s] = frozenset(x for x in seen if nfa.step[x] or x in final)
        return closures[s]

    # bytes that no set tells apart share a class
    sets = {st[0] for st in nfa.step if st}
    marks = np.zeros((256, max(1, len(sets))), bool)
    for k, members in enumerate(sets):
        marks[list(members), k] = True
    _, sample, klass = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    klass = klass.reshape(-1)

    begin = closure(start)
    ids, order, table = {begin: 0}, [begin], []
    for current in order:
        row = []
        for byte in sample.tolist():
            to = set(begin) if anywhere else set()
            for s in current:
                st = nfa.step[s]
                if st and byte in st[0]:
                    to |= closure(st[1])
            key = frozenset(to)
            if key not in ids:
                ids[key] = len(order)
                order.append(key)
            row.append(ids[key])
        table.append(row)
    move = np.array(table, np.int64)
    accepts = np.array([sum(1 << final[s] for s in subset if s in final) for subset in order], np.int64)

    # minimisation: refine the partition by accept bits until no class of states splits
    _, part = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[move]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    first_seen = np.unique(part, return_index=True)[1]
    rank = np.empty(len(first_seen), np.int64)
    rank[part[np.sort(first_seen)]] = np.arange(len(first_seen))
    part = rank[part]
    one = np.sort(first_seen)
    return Dfa(part[move[one]][:, klass].astype(np.int32), accepts[one])


class Scanner:
    """Leftmost, longest, non-overlapping matches of every rule.

    One pass over the reversed bytes with the combined automaton of the reversed rules marks, for
    all rules at once, where matches start; each rule's own automaton then runs from its leftmost
    start to the farthest end.
    """

    def __init__(self, trees: list):
        self.backward = compile_rules([reverse(t) for t in trees], anywhere=True)
        self.forward = [compile_rules([t], anywhere=False) for t in trees]
        self.start = self.backward.rows()[0]
        self.dead = [self._dead(f) for f in self.forward]
        self.bits = operator.itemgetter(256)

    @staticmethod
    def _dead(dfa: Dfa) -> set[int]:
        """States from which no accept can be reached."""
        alive = set(np.flatnonzero(dfa.accepts).tolist())
        while True:
            more = {s for s in range(len(dfa.next)) if s not in alive and alive & set(dfa.next[s].tolist())}
            if not more:
                return set(range(len(dfa.next))) - alive
            alive |= more

    def _end(self, rule: int, data: bytes, at: int) -> int:
        move, accepts, dead, state, end = self.forward[rule].next, self.forward[rule].accepts, self.dead[rule], 0, -1
        for i in range(at, len(data)):
            state = int(move[state, data[i]])
            if state in dead:
                break
            if accepts[state]:
                end = i + 1
        return end

    def scan(self, data: bytes) -> list[list[tuple[int, int]]]:
        """(start, end) byte spans by rule."""
        states = itertools.accumulate(data[::-1], operator.getitem, initial=self.start)
        marks = np.fromiter(map(self.bits, states), np.int64, len(data) + 1)[::-1]
        hits = np.flatnonzero(marks)
        found: list[list[tuple[int, int]]] = [[] for _ in self.forward]
        if not len(hits):
            return found
        free = [0] * len(found)
        for at in hits.tolist():
            bits = int(marks[at])
            while bits:
                low = bits & -bits
                bits ^= low
                rule = low.bit_length() - 1
                if at >= free[rule]:
                    end = self._end(rule, data, at)
                    if end > at:
                        found[rule].append((at, end))
                        free[rule] = end
        return found
