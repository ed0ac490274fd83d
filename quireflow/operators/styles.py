"""Citation styles: markers in the text and bibliography entries, as projections over references.

Two generations differ in details and are kept apart: in the first, authors are strings; in the second they are structs of
surname and initials. A style is an entry of a registry (name to Column function); more may be registered.
References are read from columns index, authors, year, title, journal, volume, issue, pages, doi, raw; an empty string
counts as missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, superscript
from .authors import normalised, surname

STYLES = ("apa", "vancouver", "ieee", "nature", "mla", "chicago", "harvard", "ama")
DOI_HOST = "https://doi.org/"


def field(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def after(c: Column, *ends: str) -> Column:
    return F.concat(c, *[F.lit(e) for e in ends])


def wrap(before: str, c: Column, end: str = "") -> Column:
    """Null if the field is missing, else the field between two strings."""
    return F.concat(F.lit(before), c, F.lit(end))


def missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def several(array: Column, found: Column) -> Column:
    """Null when there are no authors."""
    return F.when(F.size(F.coalesce(array, F.array())) > 0, found)


def front(array: Column, sep: str) -> Column:
    """All but the last, joined."""
    return F.array_join(F.slice(array, 1, F.greatest(F.lit(0), F.size(array) - 1)), sep)


def joined(array: Column) -> Column:
    """Names with "and" before the last, and a comma."""
    def of(all_: Column) -> Column:
        return F.when(F.size(all_) == 1, after(F.get(all_, F.lit(0)), ",")).otherwise(F.concat(front(all_, ", "), F.lit(" and "), F.try_element_at(all_, F.lit(-1)), F.lit(",")))

    return let(array, of)


class Generation:
    """What the two generations have in common: names, labels and the registries of styles."""

    header_rule = "="

    def __init__(self):
        self.markers: dict[str, Callable[[], Column]] = {}
        self.entries: dict[str, Callable[[], Column]] = {}

    def surname_at(self, i: int) -> Column:
        raise NotImplementedError

    def names(self) -> Column:
        """array of struct(surname, initials)."""
        raise NotImplementedError

    def label(self, join: str, none: Column) -> Column:
        n = F.size(F.coalesce(F.col("authors"), F.array()))
        one = self.surname_at(1)
        return F.when(n == 0, none).when(n == 1, one).when(n == 2, F.concat(one, F.lit(join), self.surname_at(2))).otherwise(after(one, " et al."))

    def marker(self, style: str) -> Column:
        if style not in self.markers:
            raise ValueError(f"unknown style {style!r}; there are {sorted(self.markers)}")
        return self.markers[style]()

    def entry(self, style: str) -> Column:
        """An unknown style gives the number and the raw entry."""
        return self.entries[style]() if style in self.entries else F.concat(F.col("index").cast("string"), F.lit(". "), F.col("raw"))


def year() -> Column:
    return F.coalesce(field("year"), F.lit("n.d."))


def number(before: str = "", end: str = "") -> Column:
    return F.concat(F.lit(before), F.col("index").cast("string"), F.lit(end))


def short_title() -> Column:
    return F.coalesce(F.substring(field("title"), 1, 20), F.lit("Anon"))


def container() -> Column:
    return F.coalesce(field("journal"), field("title"), F.lit("Anon"))


def volume_issue(open_: str = "(", close: str = ")") -> Column:
    return F.concat(field("volume"), missing(wrap(open_, field("issue"), close)))


def volume_number() -> Column:
    return F.concat(F.lit("vol. "), field("volume"), missing(wrap(", no. ", field("issue"))), F.lit(","))


def journal_block() -> Column:
    parts = F.array_compact(F.array(field("journal"), volume_issue(), field("pages")))
    return F.when(F.size(parts) > 0, after(F.array_join(parts, ", "), "."))


def linked_doi() -> Column:
    return F.when(F.startswith(field("doi"), F.lit("http")), field("doi")).otherwise(F.concat(F.lit(DOI_HOST), field("doi")))


def labelled_doi() -> Column:
    doi = F.trim(field("doi"))
    return F.when(F.lower(doi).startswith("doi"), doi).otherwise(F.concat(F.lit("doi: "), doi))


def bare_letters(initials: Column) -> Column:
    return F.regexp_replace(initials, "[. ]", "")


def spaced(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


class First(Generation):
    """The first generation."""

    def __init__(self):
        super().__init__()
        self.markers |= {
            "apa": lambda: F.concat(F.lit("("), self.label(" & ", container()), F.lit(", "), year(), F.lit(")")),
            "vancouver": lambda: number("[", "]"), "ieee": lambda: number("[", "]"), "nature": lambda: number("[", "]"),
            "mla": lambda: F.concat(F.lit("("), F.coalesce(several(F.col("authors"), self.surname_at(1)), short_title()), F.lit(")")),
            "chicago": lambda: F.concat(F.lit("("), self.label(" and ", short_title()), F.lit(" "), year(), F.lit(")")),
            "harvard": lambda: F.concat(F.lit("("), self.label(" and ", short_title()), F.lit(", "), year(), F.lit(")")),
            "ama": lambda: superscript(F.col("index").cast("string")),
        }
        self.entries |= {s: getattr(self, f"{s}_entry") for s in STYLES}

    def surname_at(self, i: int) -> Column:
        return surname(F.get(F.col("authors"), i - 1))

    def names(self) -> Column:
        return F.transform("authors", lambda a: normalised(a))

    @staticmethod
    def last_first(n: Column) -> Column:
        return F.when(n["initials"] != "", F.concat(n["surname"], F.lit(", "), n["initials"])).otherwise(n["surname"])

    @staticmethod
    def first_last(n: Column) -> Column:
        return F.when(n["initials"] != "", F.concat(n["initials"], F.lit(" "), n["surname"])).otherwise(n["surname"])

    @staticmethod
    def compact(n: Column) -> Column:
        return F.when(bare_letters(n["initials"]) != "", F.concat(n["surname"], F.lit(" "), bare_letters(n["initials"]))).otherwise(n["surname"])

    def apa_entry(self) -> Column:
        def some(all_: Column) -> Column:
            long = F.concat(F.array_join(F.slice(all_, 1, 19), ", "), F.lit(", ... "), F.element_at(all_, -1), F.lit("."))
            return F.when(F.size(all_) > 20, long).when(F.size(all_) == 1, after(F.get(all_, F.lit(0)), ".")).otherwise(F.concat(front(all_, ", "), F.lit(", & "), F.try_element_at(all_, F.lit(-1)), F.lit(".")))

        whole = spaced(several(F.col("authors"), let(F.transform(self.names(), self.last_first), some)), F.concat(F.lit("("), year(), F.lit(").")), after(field("title"), "."), journal_block(), field("doi"))
        return F.regexp_replace(whole, r"\.{2,}", ".")

    def six(self, end: str) -> Column:
        shown = F.array_join(F.transform(F.slice(self.names(), 1, 6), self.compact), ", ")
        return several(F.col("authors"), F.concat(shown, F.when(F.size("authors") > 6, end).otherwise(""), F.lit(".")))

    def vancouver_entry(self) -> Column:
        return spaced(number(end="."), self.six(", et al."), after(field("title"), "."), journal_block(), field("doi"))

    def ieee_entry(self) -> Column:
        some = joined(F.transform(self.names(), self.first_last))
        return spaced(number("[", "]"), several(F.col("authors"), some), wrap('"', field("title"), ',"'), after(field("journal"), ","), volume_number(), wrap("pp. ", field("pages"), ","), after(field("year"), "."), self.ieee_doi())

    def ieee_doi(self) -> Column:
        return after(field("doi"), ".")

    def ten(self) -> Column:
        def dotted(n: Column) -> Column:
            letters = F.regexp_replace(bare_letters(n["initials"]), "(.)", "$1.")
            return F.when(n["initials"] != "", F.concat(n["surname"], F.lit(", "), letters)).otherwise(n["surname"])

        shown = F.array_join(F.transform(F.slice(self.names(), 1, 10), dotted), ", ")
        return several(F.col("authors"), F.concat(shown, F.when(F.size("authors") > 10, " et al.").otherwise("")))

    def nature_entry(self) -> Column:
        block = F.array_compact(F.array(field("volume"), field("pages"), wrap("(", field("year"), ")")))
        return spaced(number(end="."), self.ten(), after(field("title"), "."), field("journal"), F.when(F.size(block) > 0, after(F.array_join(block, ", "), ".")), self.nature_doi())

    def nature_doi(self) -> Column:
        return field("doi")

    def leading(self, most: int) -> Column:
        """First author reversed, the rest as written; beyond ``most``, et al."""
        def of(all_: Column) -> Column:
            head = self.last_first(F.get(all_, F.lit(0)))
            rest = F.array_join(F.transform(F.slice(all_, 2, F.greatest(F.lit(1), F.size(all_))), self.first_last), ", and ")
            return F.when(F.size(all_) == 1, after(head, ".")).when(F.size(all_) > most, after(head, ", et al.")).otherwise(F.concat(head, F.lit(", and "), rest, F.lit(".")))

        return several(F.col("authors"), let(self.names(), of))

    def mla_entry(self) -> Column:
        return spaced(self.leading(3), wrap('"', field("title"), '."'), wrap("*", field("journal"), "*,"), volume_number(), after(field("year"), ","), wrap("pp. ", field("pages"), "."), field("doi"))

    def chicago_entry(self) -> Column:
        return spaced(self.leading(3), after(field("year"), "."), wrap('"', field("title"), '."'), wrap("*", field("journal"), "*"), after(volume_issue(" (", ")"), ":"), after(field("pages"), "."), field("doi"))

    def harvard_entry(self) -> Column:
        shown = F.array_join(F.transform(F.slice(self.names(), 1, 3), self.last_first), " and ")
        some = several(F.col("authors"), F.concat(shown, F.when(F.size("authors") > 3, " et al.").otherwise("")))
        whole = spaced(some, wrap("(", field("year"), ")"), wrap("‘", field("title"), "’,"), after(field("journal"), ","), wrap("vol. ", field("volume"), ","), wrap("no. ", field("issue"), ","), wrap("pp. ", field("pages"), "."), field("doi"))
        return F.regexp_replace(whole, r",\s*\.", ".")

    def ama_entry(self) -> Column:
        block = F.array_compact(F.array(field("year"), volume_issue(), field("pages")))
        shown = F.when(F.size(block) == 3, F.concat(block[0], F.lit(";"), F.get(block, F.lit(1)), F.lit(":"), F.get(block, F.lit(2)), F.lit(".")))
        shown = shown.when(F.size(block) == 2, F.concat(block[0], F.lit(";"), F.get(block, F.lit(1)), F.lit("."))).when(F.size(block) == 1, after(F.get(block, F.lit(0)), "."))
        return spaced(number(end="."), self.six(", et al."), after(field("title"), "."), after(field("journal"), "."), shown, F.concat(F.lit("doi:"), F.replace(field("doi"), F.lit(DOI_HOST), F.lit(""))))


class Second(First):
    """The second generation: authors are structs of surname and initials."""

    header_rule = "─"

    def __init__(self):
        super().__init__()
        self.markers |= {
            "nature": lambda: superscript(F.col("index").cast("string")),
            "mla": lambda: F.concat(F.lit("("), F.when(F.size(F.coalesce(F.col("authors"), F.array())) > 1, after(self.surname_at(1), " et al.")).otherwise(F.coalesce(self.surname_at(1), short_title())), F.lit(")")),
            "harvard": lambda: F.concat(F.lit("("), self.label(" and ", container()), F.lit(", "), year(), F.lit(")")),
        }

    def surname_at(self, i: int) -> Column:
        return F.get(F.col("authors"), i - 1)["surname"]

    def names(self) -> Column:
        return F.col("authors")

    def apa_entry(self) -> Column:
        def one(n: Column) -> Column:
            dots = F.regexp_replace(F.regexp_replace(F.replace(n["initials"], F.lit(" "), F.lit(". ")), r"([A-Z])(?!\.)", "$1."), r"\.{2,}", ".")
            return F.when(n["initials"] != "", F.concat(n["surname"], F.lit(", "), dots)).otherwise(n["surname"])

        def some(all_: Column) -> Column:
            last = F.try_element_at(all_, F.lit(-1))
            ended = F.when(F.endswith(last, F.lit(".")), last).otherwise(after(last, "."))
            long = F.concat(F.array_join(F.slice(all_, 1, 19), ", "), F.lit(", ... "), last, F.lit("."))
            return F.when(F.size(all_) > 20, long).when(F.size(all_) == 1, ended).otherwise(F.concat(front(all_, ", "), F.lit(", & "), ended))

        whole = spaced(several(F.col("authors"), let(F.transform(self.names(), one), some)), F.concat(F.lit("("), year(), F.lit(").")), after(field("title"), "."), journal_block(), linked_doi())
        return F.regexp_replace(whole, r"\.{2,}", ".")

    def vancouver_entry(self) -> Column:
        parts = F.array_compact(F.array(field("journal"), field("year"), volume_issue(), field("pages")))
        block = F.when(F.size(parts) == 4, F.concat(F.array_join(F.slice(parts, 1, 3), ";"), F.lit(":"), field("pages"), F.lit("."))).when(F.size(parts) > 0, after(F.array_join(parts, ", "), "."))
        return spaced(number(end="."), self.six(", et al."), after(field("title"), "."), block, labelled_doi())

    @staticmethod
    def first_last_dotted(n: Column) -> Column:
        letters = F.concat(F.array_join(F.filter(F.split(bare_letters(n["initials"]), ""), lambda c: c != ""), ". "), F.lit("."))
        return F.when(n["initials"] != "", F.concat(letters, F.lit(" "), n["surname"])).otherwise(n["surname"])

    def ieee_entry(self) -> Column:
        some = joined(F.transform(self.names(), self.first_last_dotted))
        return spaced(number("[", "]"), several(F.col("authors"), some), wrap('"', field("title"), ',"'), after(field("journal"), ","), volume_number(), wrap("pp. ", field("pages"), ","), after(field("year"), "."), after(labelled_doi(), "."))

    def nature_doi(self) -> Column:
        doi = F.trim(field("doi"))
        return F.when(F.startswith(doi, F.lit("http")), doi).otherwise(F.concat(F.lit(DOI_HOST), doi))

    def harvard_entry(self) -> Column:
        some = joined(F.transform(self.names(), lambda n: n["surname"]))
        block = F.concat(field("journal"), missing(wrap(", ", volume_issue())), missing(wrap(", pp. ", field("pages"))), F.lit("."))
        return spaced(several(F.col("authors"), some), F.concat(F.lit("("), year(), F.lit(").")), wrap("'", field("title"), "',"), block, wrap("Available at: ", linked_doi()))

    def ama_entry(self) -> Column:
        block = F.concat(field("journal"), F.lit("."), missing(wrap(" ", field("year"))), missing(wrap(";", volume_issue())), missing(wrap(":", field("pages"))), F.lit("."))
        return spaced(number(end="."), self.six(", et al"), after(field("title"), "."), block, wrap("doi:", linked_doi()))

    def listed(self) -> Column:
        """The first author reversed, the others as written."""
        def of(all_: Column) -> Column:
            return F.concat(F.transform(F.slice(all_, 1, 1), self.last_first), F.transform(F.slice(all_, 2, F.greatest(F.lit(1), F.size(all_))), self.first_last))

        return let(self.names(), of)

    def mla_entry(self) -> Column:
        some = let(self.listed(), lambda all_: F.when(F.size(all_) > 3, after(F.get(all_, F.lit(0)), ", et al.")).otherwise(after(F.array_join(all_, ", and "), ".")))
        volume = F.concat(F.lit(" vol. "), field("volume"), F.lit(","), missing(wrap(" no. ", field("issue"), ",")))
        block = F.concat(field("journal"), F.lit(","), missing(volume), missing(wrap(" ", field("year"), ",")), missing(wrap(" pp. ", field("pages"), ".")))
        return spaced(several(F.col("authors"), some), wrap('"', field("title"), '."'), block, linked_doi())

    def chicago_entry(self) -> Column:
        def shown(all_: Column) -> Column:
            first = F.get(all_, F.lit(0))
            return F.when(F.size(all_) > 10, after(first, ", et al.")).when(F.size(all_) == 1, after(first, ".")).otherwise(F.concat(front(all_, ", "), F.lit(", and "), F.try_element_at(all_, F.lit(-1)), F.lit(".")))

        some = let(self.listed(), shown)
        block = F.concat(field("journal"), missing(F.concat(F.lit(" "), field("volume"), missing(wrap(", no. ", field("issue"))))), missing(wrap(" (", field("year"), ")")), missing(wrap(": ", field("pages"))), F.lit("."))
        return spaced(several(F.col("authors"), some), after(year(), "."), wrap('"', field("title"), '."'), block, F.concat(F.lit(DOI_HOST), linked_doi(), F.lit(".")))


class Prepared(First):
    """The first generation over authors that are structs already."""

    def surname_at(self, i: int) -> Column:
        return F.get(F.col("authors"), i - 1)["surname"]

    def names(self) -> Column:
        return F.col("authors")


FIRST, SECOND = First(), Second()
_PREPARED = Prepared()


def prepared(refs: DataFrame, generation: Generation) -> tuple[DataFrame, Generation]:
    """Names are taken apart once for all styles."""
    if type(generation) is not First:
        return refs, generation
    ready = Prepared()
    ready.markers |= {k: v for k, v in generation.markers.items() if k not in _PREPARED.markers}
    ready.entries |= {k: v for k, v in generation.entries.items() if k not in _PREPARED.entries}
    return refs.withColumn("authors", F.transform("authors", lambda a: normalised(a))), ready


def styled(refs: DataFrame, generation: Generation, what: str, keep: tuple[str, ...] = ("doc_id", "index")) -> DataFrame:
    """A row for each reference and style with its marker or entry."""
    refs, generation = prepared(refs, generation)
    make = generation.marker if what == "marker" else generation.entry
    pairs = F.array(*[F.struct(F.lit(s).alias("style"), make(s).alias("text")) for s in STYLES])
    return refs.select(*keep, F.inline(pairs))


def bibliography(refs: DataFrame, generation: Generation, style: str, by: str = "doc_id") -> DataFrame:
    """The whole section of every document: head, rule, entries by number, blank lines between."""
    refs, generation = prepared(refs, generation)
    entries = refs.select(by, F.struct(F.col("index"), generation.entry(style).alias("entry")).alias("e"))
    head = "References\n" + generation.header_rule * 60
    ordered = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"])
    return entries.groupBy(by).agg(F.array_join(F.concat(F.array(F.lit(head)), ordered), "\n\n").alias("bibliography"))
