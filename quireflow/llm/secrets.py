"""Secret scans: all rules compiled into one deterministic byte automaton and scanned in a single pass.

The pass reports where a match of which rule can end. At the first such end the rule's mirrored automaton walks back to
the leftmost start and its own automaton forward to the longest end; the rule goes on behind that. So each rule's matches
are leftmost, longest and non-overlapping. A match that fails the rule's own test is dropped, without another try.

Defined results: a null or empty text has no spans (the digest is that of an empty text). Offsets count code points, ends
are exclusive. Repeated rows each get their own row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

from pyspark.sql import DataFrame

from .automaton import Automaton, Parser, compile_rules, reverse
from .common import map_texts


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; ``seek`` may be a stricter pattern that ends in the same matches when they pass ``test``."""

    kind: str
    pattern: str
    test: Callable[[bytes], bool] | None = None
    ignore_case: bool = False
    seek: str | None = None


VALUE = re.compile(rb"[:=] *[\"']?([A-Za-z0-9+/_.=-]+)\Z")


def long_value(match: bytes) -> bool:
    """Whether the assigned value, which follows the first separator, has 8 characters or more."""
    return len(VALUE.search(match, re.search(rb"[:=]", match).start())[1]) >= 8


def access_length(match: bytes) -> bool:
    return len(match) >= 16


def hex_length(match: bytes) -> bool:
    return len(match) >= 32


def token_length(match: bytes) -> bool:
    return len(match) >= 20


#: The base rules, in the order in which spans with the same start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", long_value, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", access_length),
    Rule("hex", r"[0-9a-f]+", hex_length, seek=r"[0-9a-f]{8,}"),
)
#: Rules that this operator adds: private key headers and prefixed service tokens.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("service_token", r"(ghp_|xoxb-|sk_live_|glpat-)[A-Za-z0-9_\-]+", token_length),
)


class Scanner:
    """The combined automaton, and for each rule one forward and one mirrored automaton."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nodes = [Parser(r.pattern, r.ignore_case).parse() for r in rules]
        self.all = compile_rules([Parser(r.seek or r.pattern, r.ignore_case).parse() for r in rules], unanchored=True)
        self.rows, self.accepts = self.all.rows(), self.all.accepts.tolist()
        self.forward = [self.single(n) for n in nodes]
        self.backward = [self.single(reverse(n)) for n in nodes]
        # states without an accept come first, so that the pass compares a number
        order = sorted(range(len(self.accepts)), key=lambda s: (self.accepts[s] != 0, s))
        to = {s: i for i, s in enumerate(order)}
        self.rows = [[to[t] for t in self.rows[s]] for s in order]
        self.accepts = [self.accepts[s] for s in order]
        self.start, self.quiet = to[self.all.start], sum(a == 0 for a in self.accepts)

    @staticmethod
    def single(node) -> tuple[list[list[int]], list[bool], int, set[int]]:
        a: Automaton = compile_rules([node], unanchored=False)
        rows = a.rows()
        dead = {s for s, r in enumerate(rows) if not a.accepts[s] and set(r) == {s}}
        return rows, [bool(x) for x in a.accepts], a.start, dead

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """One pass: (end, rules) wherever some rule's match can end."""
        rows, state, quiet, accepts = self.rows, self.start, self.quiet, self.accepts
        for i, byte in enumerate(data, 1):
            state = rows[state][byte]
            if state >= quiet:
                yield i, accepts[state]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match that passes its rule's test, by start and rule, in bytes."""
        out, behind = [], [0] * len(self.rules)
        done = 0  # rules whose last match reaches beyond the pass, as bits
        quiet_until = 0
        for end, which in self.ends(data):
            if end <= quiet_until and not which & ~done:
                continue
            for k, rule in enumerate(self.rules):
                if which >> k & 1 and end > behind[k]:
                    begin = self.walk(self.backward[k], data, range(end - 1, behind[k] - 1, -1), end, 0)
                    if begin == end:  # it would have to start within the match before
                        continue
                    behind[k] = stop = self.walk(self.forward[k], data, range(begin, len(data)), begin, 1)
                    if rule.test is None or rule.test(data[begin:stop]):
                        out.append((begin, stop, k))
            done, quiet_until = 0, min((b for b in behind if b > end), default=0)
            for k, b in enumerate(behind):
                done |= (b > end) << k
        return sorted(out, key=lambda s: (s[0], s[2]))

    @staticmethod
    def walk(single, data: bytes, steps: range, at: int, ahead: int) -> int:
        """The last position in the direction of ``steps`` at which the automaton accepts."""
        rows, accepts, state, dead = single
        for i in steps:
            state = rows[state][data[i]]
            if accepts[state]:
                at = i + ahead
            elif state in dead:
                break
        return at


@cache
def scanner(rules: tuple[Rule, ...] = BASE + EXTRA) -> Scanner:
    return Scanner(rules)


def find(text: str, scan: Scanner) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    data = text.encode("utf-8", "replace")
    found = scan.spans(data)
    if not found or len(data) == len(text):
        return [(scan.rules[k].kind, s, e) for s, e, k in found]
    out, at, behind = [], 0, 0
    for s, e, k in found:  # by start, so that the text is decoded once
        at += len(data[behind:s].decode("utf-8"))
        behind = s
        out.append((scan.rules[k].kind, at, at + len(data[s:e].decode("utf-8"))))
    return out


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, text_col: str = "text", keep=("doc_id",), extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """The ``keep`` columns, counts and digest of the base spans, and all spans, of every whole text."""
    kinds = [r.kind for r in BASE]
    shared = docs.sparkSession.sparkContext.broadcast(scanner(BASE + extra))  # as large as the rules make it

    def make_kernel():
        scan_all = shared.value

        def one(text):
            spans = find(text, scan_all)
            base = [s for s in spans if s[0] in kinds]
            return (*[sum(s[0] == k for s in base) for k in kinds], sha256(listed(base).encode()).hexdigest(), listed(spans))

        return lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)]

    fields = [*[(f"n_{k}", "bigint") for k in kinds], ("base_sha256", "string"), ("spans", "string")]
    return map_texts(docs, text_col, make_kernel, fields, list(keep))
