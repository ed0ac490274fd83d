"""Sentences of a text with their offsets. The scanners look back and ahead and skip, so they run on Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<text:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rules:
    """``abbreviation`` is looked for in the 24 characters up to a dot; ``opens`` may begin a sentence besides capitals."""

    abbreviation: str
    opens: str
    initials: bool
    window_in_sentence: bool


#: Abbreviations of the citing scanner (anywhere in the window) and of the style detector (at the dot).
CITING = Rules(r"(?i)\b(et\s+al|vs|e\.g|i\.e|fig|eq|approx|dept|prof|dr|mr|ms|mrs|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec|vol|no|pp|ed|eds|rev|suppl|approx|incl|excl|ref|refs)\.", "[(", True, False)
DETECTING = Rules(r"(?i)\b(?:et al|e\.g|i\.e|fig|eq|dr|mr|ms|mrs|prof|vs|no|vol|pp)\.$", "\"'", False, True)
#: An end and the next character that is no white space.
END = re.compile(r"[.!?](?=\s*(\S?))")


def pieces(text: str, rules: Rules) -> list[tuple[str, int, int]]:
    """(text, start, end) of sentences without white space around; offsets from 0, ends exclusive."""
    out, start, n, abbreviation = [], 0, len(text), re.compile(rules.abbreviation)

    def put(raw: str, end: int) -> None:
        if kept := raw.strip():
            out.append((kept, start + len(raw) - len(raw.lstrip()), end))

    for m in END.finditer(text):
        i, following = m.start(), m[1]
        if following and not following.isupper() and following not in rules.opens:
            continue
        if text[i] == ".":
            if 0 < i < n - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
                continue
            if rules.initials and i > 0 and text[i - 1].isupper() and (i == 1 or not text[i - 2].isalpha()):
                continue
            if abbreviation.search(text[max(start if rules.window_in_sentence else 0, i - 24) : i + 1]):
                continue
        put(text[start : i + 1], i + 1)
        start = m.start(1)
    put(text[start:], len(text.rstrip()))
    return out


def split(text: str, rules: Rules) -> list[dict]:
    """Sentences without white space around; offsets from 0, ends exclusive."""
    return [{"text": t, "start": start, "end": end} for t, start, end in pieces(text, rules)]


def sentences(c: Column, rules: Rules = CITING) -> Column:
    """Array of (text, start, end)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([split(t or "", rules) for t in texts])

    return F.pandas_udf(run, SPANS)(c)
