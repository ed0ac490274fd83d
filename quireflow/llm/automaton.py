"""Regular expressions to one minimal byte automaton: Thompson construction, subset construction, Moore minimisation.

The expressions are the plain regular ones: literals, escapes, classes, groups, alternation, ``* + ? {m} {m,} {m,n}``.
The automaton of several rules is unanchored: in every state it knows which rules have a match that ends here.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = (1 << 256) - 1
#: Subset construction stops with an error beyond this.
MAX_STATES = 50_000
ESCAPES = {"d": "0123456789", "n": "\n", "t": "\t", "r": "\r", "s": " \t\n\r\x0b\x0c", "w": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}


@dataclass
class Automaton:
    """``table[state * n_classes + classes[byte]]`` is the next state; ``accepts[state]`` is a bit for each rule."""

    classes: bytes
    table: np.ndarray
    accepts: np.ndarray
    start: int

    def rows(self) -> list[list[int]]:
        """For each state, the next state of each byte."""
        of = np.frombuffer(self.classes, np.uint8)
        return [r[of].tolist() for r in self.table]


def bits(chars: str) -> int:
    out = 0
    for c in chars:
        out |= 1 << ord(c)
    return out


class Parser:
    """Recursive descent over a pattern; a node is ('set', bits), ('cat', nodes), ('alt', nodes) or ('rep', node, min, max)."""

    def __init__(self, pattern: str, ignore_case: bool = False):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return node

    def alternatives(self):
        out = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def sequence(self):
        out = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            out.append(self.repeated())
        return ("cat", out)

    def repeated(self):
        node = self.atom()
        while self.i < len(self.p) and self.p[self.i] in "*+?{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                lo, _, hi = self.p[self.i : end].partition(",")
                node = ("rep", node, int(lo), int(lo) if "," not in self.p[self.i : end] else int(hi) if hi else None)
                self.i = end + 1
            else:
                node = ("rep", node, *{"*": (0, None), "+": (1, None), "?": (0, 1)}[c])
        return node

    def cased(self, chars: str) -> int:
        return bits(chars.lower() + chars.upper()) if self.fold and chars.isascii() else bits(chars)

    def escape(self) -> str:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return chr(int(self.p[self.i - 2 : self.i], 16))
        return ESCAPES.get(c, c)

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives()
            self.i += 1
            return node
        if c == "[":
            return ("set", self.klass())
        if c == ".":
            return ("set", ANY & ~bits("\n"))
        return ("set", self.cased(self.escape() if c == "\\" else c))

    def klass(self) -> int:
        negated = self.p[self.i] == "^"
        self.i += negated
        out, first = 0, True
        while first or self.p[self.i] != "]":
            first = False
            c = self.p[self.i]
            self.i += 1
            c = self.escape() if c == "\\" else c
            if len(c) == 1 and self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                hi = self.p[self.i + 1]
                self.i += 2
                hi = self.escape() if hi == "\\" else hi
                c = "".join(map(chr, range(ord(c), ord(hi) + 1)))
            out |= self.cased(c)
        self.i += 1
        return ANY & ~out if negated else out


class Nfa:
    """Thompson automaton: ``moves[s]`` are (bits, target) pairs, ``empty[s]`` the targets without a byte."""

    def __init__(self):
        self.moves: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node, at: int) -> int:
        """Wire a node in behind a state; the state where it ends."""
        if node[0] == "set":
            self.moves[at].append((node[1], end := self.state()))
            return end
        if node[0] == "cat":
            for x in node[1]:
                at = self.add(x, at)
            return at
        if node[0] == "alt":
            end = self.state()
            for x in node[1]:
                self.empty[at].append(begin := self.state())
                self.empty[self.add(x, begin)].append(end)
            return end
        _, inner, lo, hi = node
        for _ in range(lo):
            at = self.add(inner, at)
        if hi is None:
            self.empty[at].append(loop := self.state())
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end := self.state())
            return end
        end = self.state()
        for _ in range(hi - lo):
            self.empty[at].append(end)
            at = self.add(inner, at)
        self.empty[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)


def reverse(node):
    """The expression of the mirrored language."""
    if node[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    return node if node[0] == "set" else ("rep", reverse(node[1]), *node[2:])


def compile_rules(nodes: list, unanchored: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation. Rule k accepts with bit k."""
    nfa = Nfa()
    root = nfa.state()
    finals = {}
    for k, node in enumerate(nodes):
        nfa.empty[root].append(begin := nfa.state())
        finals[nfa.add(node, begin)] = 1 << k
    labels = sorted({m for moves in nfa.moves for m, _ in moves})
    signature = [tuple(m >> b & 1 for m in labels) for b in range(256)]
    index = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = bytes(index[s] for s in signature)
    sample = [classes.index(c) for c in range(len(index))]
    # subsets of states are bit sets; leads[s][class] is all that a byte of the class reaches from s
    reach = [sum(1 << t for t in nfa.closure([s])) for s in range(len(nfa.moves))]
    leads = []
    for moves in nfa.moves:
        row = [0] * len(sample)
        for m, t in moves:
            for c, b in enumerate(sample):
                if m >> b & 1:
                    row[c] |= reach[t]
        leads.append(row if moves else None)
    again = reach[root] if unanchored else 0
    states, subsets, table = {reach[root]: 0}, [reach[root]], []
    for here in subsets:  # grows while it is read
        rows, rest = [], here
        while rest:
            low = rest & -rest
            if leads[low.bit_length() - 1]:
                rows.append(leads[low.bit_length() - 1])
            rest ^= low
        row = []
        for c in range(len(sample)):
            nxt = again
            for r in rows:
                nxt |= r[c]
            if nxt not in states:
                if len(states) >= MAX_STATES:
                    raise ValueError(f"the rules need more than {MAX_STATES} states")
                states[nxt] = len(states)
                subsets.append(nxt)
            row.append(states[nxt])
        table.append(row)
    accepts = [0] * len(states)
    for i, subset in enumerate(subsets):
        for s, rule in finals.items():
            if subset >> s & 1:
                accepts[i] |= rule
    return minimise(classes, np.array(table, np.int32), np.array(accepts, np.int64))


def minimise(classes: bytes, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Moore: split blocks of states by where they lead until no block splits."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    return Automaton(classes, block[table[first]].astype(np.int32), accepts[first], int(block[0]))
