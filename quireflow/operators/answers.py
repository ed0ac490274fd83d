"""Answers of a language model, as texts: only well-formed and allowed parts of their JSON are taken.

The model itself is no part of this library; its answers come as a column. An answer without the kind of JSON that is asked
for gives null (a list gives none).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip
from .metadata import json_in, some

#: Fields of a reference, levels of confidence that a suggestion may have, and its limits.
FIELDS = ("year", "title", "journal", "volume", "issue", "pages", "doi", "ref_type")
LEVELS = ("high", "medium")
MOST, SENTENCE, REASON = 8, 150, 200
ITEM = "struct<sentence:string,reason:string,confidence:string>"


def _of_kind(answer: Column, opening: str, use) -> Column:
    return let(json_in(answer), lambda j: F.when(F.startswith(strip(j), F.lit(opening)), use(j)))


def reference(answer: Column) -> Column:
    """struct of FIELDS and authors: text values without white space around, null where empty; authors that are texts."""
    schema = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",authors:array<string>>"

    def of(x: Column) -> Column:
        names = F.transform(F.filter(F.coalesce(x["authors"], F.array().cast("array<string>")), lambda a: some(a).isNotNull()), strip)
        return F.struct(*[some(strip(x[f])).alias(f) for f in FIELDS], names.alias("authors"))

    return _of_kind(answer, "{", lambda j: let(F.from_json(j, schema), of))


def suggestions(answer: Column) -> Column:
    """Array of (sentence, reason, confidence): of the first MOST items, those with both texts and an allowed confidence."""
    def item(x: Column) -> Column:
        return F.struct(strip(F.coalesce(x["sentence"], F.lit(""))).alias("sentence"), strip(F.coalesce(x["reason"], F.lit(""))).alias("reason"), F.lower(F.coalesce(x["confidence"], F.lit("medium"))).alias("confidence"))

    def kept(x: Column) -> Column:
        return (x["sentence"] != "") & (x["reason"] != "") & x["confidence"].isin(*LEVELS)

    def cut(x: Column) -> Column:
        return F.struct(F.substring(x["sentence"], 1, SENTENCE).alias("sentence"), F.substring(x["reason"], 1, REASON).alias("reason"), x["confidence"].alias("confidence"))

    def of(items: Column) -> Column:
        return F.transform(F.filter(F.transform(F.filter(F.slice(items, 1, MOST), lambda x: x.isNotNull()), item), kept), cut)

    return F.coalesce(_of_kind(answer, "[", lambda j: let(F.coalesce(F.from_json(j, f"array<{ITEM}>"), F.array().cast(f"array<{ITEM}>")), of)), F.array().cast(f"array<{ITEM}>"))


def style(answer: Column) -> Column:
    """struct(style, explanation) of an answer that names a style."""
    return _of_kind(answer, "{", lambda j: let(F.from_json(j, "struct<style:string,explanation:string>"), lambda x: F.when(x["style"].isNotNull(), x)))
