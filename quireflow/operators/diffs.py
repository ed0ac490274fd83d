"""Differences between an original and a cited text: by word, by line, and as HTML."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import decimals

AHEAD = 12
MARKS = r"(\([A-Z][a-z]+(?:\s+et\s+al\.)?(?:,\s*\d{4})?(?:\s*[a-z])?\)|\[\d+\]|[⁰¹²³⁴⁵⁶⁷⁸⁹]+)"
CHUNKS = "array<struct<type:string,text:string>>"


def is_marker(token: Column) -> Column:
    """A token that begins with an opening bracket, or is a single closing one."""
    return token.rlike(r"^[(\[{]") | token.rlike(r"^[)\]}]$")


def _aligned(old: list[str], new: list[str]) -> Iterator[tuple[str, str]]:
    """Tokens with their type. Each token of the new text looks for its place among the next AHEAD of the old one, and what
    the old text has up to there is kept; without a place it is inserted. A marker's place is the very next one, and only
    if no inserted token stands before it."""
    places: dict[str, list[int]] = {}
    for at, token in enumerate(old):
        places.setdefault(token, []).append(at)
    behind, after_inserted = 0, False
    for token in new:
        own = places.get(token, [])
        at = bisect_left(own, behind)
        reach = (0 if after_inserted else 1) if re.match(r"[(\[{]|[)\]}]$", token) else AHEAD
        after_inserted = at == len(own) or own[at] >= behind + reach
        if not after_inserted:
            yield from (("norm", t) for t in old[behind : own[at] + 1])
            behind = own[at] + 1
        else:
            yield "inserted", token
    yield from (("norm", t) for t in old[behind:])


def _chunks(original: str, cited: str) -> list[dict[str, str]]:
    """Runs of tokens of one type."""
    typed = _aligned((original or "").split(), (cited or "").split())
    return [{"type": kind, "text": "".join(f"{t} " for _, t in run)} for kind, run in groupby(typed, key=itemgetter(0))]


def word_diff(original: Column, cited: Column) -> Column:
    """Array of (type, text); the scan depends on its own state, so it runs on Arrow batches in Python."""

    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([_chunks(o, c) for o, c in zip(old, new, strict=True)])

    return F.pandas_udf(run, CHUNKS)(original, cited)


def line_diff(original: Column, cited: Column, most: int = 30) -> Column:
    """Array of (line, original, cited) for lines that differ, up to ``most``."""
    old, new = F.split(original, "\n"), F.split(cited, "\n")
    n = F.least(F.size(old), F.size(new))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("line"), F.element_at(old, i).alias("original"), F.element_at(new, i).alias("cited")))
    return F.slice(F.filter(pairs, lambda p: p["original"] != p["cited"]), 1, most)


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def marked_html(c: Column) -> Column:
    """Escaped text with citation markers wrapped in mark elements."""
    return F.regexp_replace(escape(c), MARKS, '<mark class="cite">$1</mark>')


def html_report(name: Column, style: Column, text: Column, total: Column, cited: Column, confidence: Column) -> Column:
    head = F.format_string("<!DOCTYPE html>\n<html lang=\"en\"><head><meta charset=\"UTF-8\"><title>%s</title></head>\n<body><h1>%s</h1>\n<p>Style: <strong>%s</strong>; references: %d; cited: %d; average confidence: %s%%</p>\n<pre>", escape(name), escape(name), F.upper(style), total, cited, decimals(confidence, 0))
    return F.concat(head, marked_html(text), F.lit("</pre>\n</body></html>"))
