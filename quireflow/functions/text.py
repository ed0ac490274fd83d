"""Column functions over texts: normal forms, words, windows, n-grams, spans, excerpts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    """Lower case, anything but letters, digits and underscores to a space, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def single_spaces(c: Column) -> Column:
    """Any run of white space to a space. Spaces that are single already are not replaced."""
    return F.regexp_replace(c, r"[\t\n\x0B\f\r]\s*| \s+", " ")


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def normal_words(c: Column) -> Column:
    return words(normalise(c))


def ngrams(array: Column, n: int) -> Column:
    """All n-grams in order, repeats included, joined by a space; none if there are fewer than n words."""
    grams = F.transform(F.sequence(F.lit(1), F.size(array) - (n - 1)), lambda i: F.array_join(F.slice(array, i, n), " "))
    return F.when(F.size(array) >= n, grams).otherwise(F.array().cast("array<string>"))


def shingles(array: Column, n: int = 5) -> Column:
    """Distinct n-grams."""
    return F.array_distinct(ngrams(array, n))


def content_words(array: Column, stopwords: Iterable[str], longer_than: int = 2) -> Column:
    return F.filter(array, lambda w: ~w.isin(sorted(stopwords)) & (F.length(w) > longer_than))


def rare_phrases(array: Column, stopwords: Iterable[str], n: int = 6, least: int = 2) -> Column:
    """Distinct n-grams with at least ``least`` words that are no stopwords, sorted. Every word is looked up once."""
    none = F.array().cast("array<string>")

    def of(words_: Column, stops: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words_) - (n - 1)), lambda i: n - F.aggregate(F.slice(stops, i, n), F.lit(0), lambda a, x: a + x) >= least)
        return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words_, i, n), " "))))

    def flagged(words_: Column) -> Column:
        return let(F.transform(words_, lambda w: w.isin(sorted(stopwords)).cast("int")), lambda stops: of(words_, stops))

    return let(array, lambda words_: F.when(F.size(words_) >= n, flagged(words_)).otherwise(none))


def excerpt(c: Column, limit: int) -> Column:
    """Single spaces, and at most ``limit`` characters with an ellipsis for what was cut."""
    flat = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"\s+$", ""), F.lit("…"))).otherwise(flat)


def preview(c: Column, n: int = 15) -> Column:
    """The first n words, with dots if there are more."""
    w = words(c)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, "...").otherwise(""))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def percent(c: Column) -> Column:
    """Whole percent, half to even."""
    return F.rint(c * 100).cast("int")


def decimals(c: Column, places: int) -> Column:
    """A number with so many decimal places, its exact value rounded half to even."""
    return F.replace(F.format_number(c, places), F.lit(","), F.lit(""))


def superscript(c: Column) -> Column:
    return F.translate(c, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def from_superscript(c: Column) -> Column:
    return F.translate(c, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


def expand_numbers(c: Column, dashes: str = "-–") -> Column:
    """``1,2-4`` to [1, 2, 3, 4]; a descending range gives nothing."""
    def part(p: Column) -> Column:
        lo, hi = (F.regexp_extract(p, rf"^\s*(\d+)\s*(?:[{dashes}]\s*(\d+))?\s*$", g) for g in (1, 2))
        first, last = lo.try_cast("int"), F.when(hi == "", lo).otherwise(hi).try_cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.split(c, ","), part))


#: Elements that one fold appends to; code points of a block.
BLOCK, CUT = 256, 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used, also within functions of elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of whole numbers, all before it merged (an associative function with neutral 0), as an array.

    An appending fold copies what it has; so it runs over blocks, and then over the blocks' results.
    """
    zero = F.lit(0).cast("long")

    def fold(part: Column, first: Column) -> Column:
        start = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(merge(acc["at"], x).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def over(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: merge(acc, x).cast("long")))
        return F.flatten(F.zip_with(blocks, fold(whole, zero), fold))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / BLOCK))), lambda i: F.slice(v, (i * BLOCK + 1).cast("int"), BLOCK))

    return let(let(values, cut), over)


def with_pieces(c: Column, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``use`` with a function for the text from one offset to another, whose cost does not grow with the offset."""
    def over(blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first, last = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
            head = F.substr(F.coalesce(F.get(blocks, first), F.lit("")), (start - first * CUT + 1).cast("int"), (F.least(end, (first + 1) * CUT) - start).cast("int"))
            middle = F.array_join(F.slice(blocks, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
            return F.concat(head, middle, F.when(last > first, F.substr(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), (end - last * CUT).cast("int"))).otherwise(""))

        return use(piece)

    return let(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), over)


def placed(found: Column, between: Column, one: Callable[[Column, Column, Column], Column]) -> Column:
    """``one(start, text before, match)`` for all matches of a text that is cut at them into the pieces ``between``."""
    def over(pairs: Column) -> Column:
        at = running(F.transform(pairs, lambda p: F.length(p["b"]) + F.length(p["m"])), lambda a, b: a + b)
        return F.zip_with(pairs, at, lambda p, before: one((before + F.length(p["b"])).cast("int"), p["b"], p["m"]))

    return let(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), over)


def spans(c: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, text): 0-based offsets, ends exclusive."""
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    return placed(found, between, lambda start, _, m: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text")))
