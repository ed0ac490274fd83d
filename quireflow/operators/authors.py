"""Author names: surname and initials of one name, and lists of names cut from one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip

INITIALS = r"^[A-Z]{1,3}\.?$"


def is_initials(c: Column) -> Column:
    return c.rlike(INITIALS)


def bare(c: Column) -> Column:
    """Without white space around and without dots and commas at the end."""
    return F.regexp_replace(strip(c), r"[.,]+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def initials(parts: Column) -> Column:
    """First letters, in upper case and dotted, of an array of names."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " ")


def surname(c: Column) -> Column:
    """Before a comma; before trailing initials; else the last word."""
    def of(name: Column, t: Column) -> Column:
        return (F.when(F.contains(name, F.lit(",")), strip(F.substring_index(name, ",", 1)))
                .when(F.size(t) == 0, name)
                .when((F.size(t) >= 2) & is_initials(F.element_at(t, -1)), F.element_at(t, 1))
                .otherwise(F.element_at(t, -1)))

    return let(bare(c), lambda name: let(tokens(name), lambda t: of(name, t)))


def normalised(c: Column, second: bool = False) -> Column:
    """struct(surname, initials). ``second``: given names after a comma that end in a dot are taken as they stand."""
    def given(after: Column) -> Column:
        if not second:
            return initials(tokens(after))
        return let(initials(F.filter(tokens(after), lambda p: ~F.endswith(p, F.lit(".")))), lambda dotted: F.when(dotted == "", after).otherwise(dotted))

    def pair(name: Column, letters: Column) -> Column:
        return F.struct(name.alias("surname"), letters.alias("initials"))

    def words(name: Column, t: Column) -> Column:
        return (F.when(F.size(t) == 0, pair(name, F.lit("")))
                .when((F.size(t) >= 2) & is_initials(F.element_at(t, -1)), pair(F.element_at(t, 1), initials(F.slice(t, 2, F.size(t)))))
                .otherwise(pair(F.element_at(t, -1), initials(F.slice(t, 1, F.greatest(F.lit(0), F.size(t) - 1))))))

    def of(name: Column) -> Column:
        reversed_ = pair(strip(F.substring_index(name, ",", 1)), given(strip(F.substr(name, F.instr(name, ",") + 1, F.length(name)))))
        return F.when(F.contains(name, F.lit(",")), reversed_).otherwise(let(tokens(name), lambda t: words(name, t)))

    return let(bare(c), of)
