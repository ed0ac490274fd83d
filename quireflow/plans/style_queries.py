"""Style queries over the derived references, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.authors import normalised
from ..operators.styles import FIRST, SECOND, bibliography, styled
from .manuscripts import REFERENCES_SQL, references


def second_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).withColumn("authors", F.transform("authors", lambda a: normalised(a, second=True)))


def style_markers_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM-1 to FM-6, first generation."""
    return styled(references(spark, sf_dir), FIRST, "marker").withColumnRenamed("index", "idx")


def style_markers_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM-2 to FM-6, second generation."""
    return styled(second_refs(spark, sf_dir), SECOND, "marker").withColumnRenamed("index", "idx")


def style_entries_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM-8 to FM-17, first generation."""
    return styled(references(spark, sf_dir), FIRST, "entry").withColumnRenamed("index", "idx")


def style_entries_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM-8 to FM-17, second generation."""
    return styled(second_refs(spark, sf_dir), SECOND, "entry").withColumnRenamed("index", "idx")


def bibliography_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM-7."""
    return bibliography(references(spark, sf_dir), FIRST, "vancouver")


def bibliography_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM-7."""
    return bibliography(second_refs(spark, sf_dir), SECOND, "mla")


def _label(join: str, none: str) -> str:
    return f"case len(sur) when 0 then {none} when 1 then sur[1] when 2 then sur[1] || '{join}' || sur[2] else sur[1] || ' et al.' end"


SHORT, BOX, Y = "coalesce(title[1:20], 'Anon')", "coalesce(jr, title, 'Anon')", "coalesce(yr, 'n.d.')"
SUP = "translate(idx::varchar, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')"
VI = "vol || coalesce('(' || iss || ')', '')"
VN = "'vol. ' || vol || coalesce(', no. ' || iss, '') || ','"
LINK = "case when starts_with(doi, 'http') then doi else 'https://doi.org/' || doi end"
LDOI = "case when starts_with(lower(doi), 'doi') then doi else 'doi: ' || doi end"
JB = f"nullif(concat_ws(', ', jr, {VI}, pg), '') || '.'"
HAS = "case when len(sur) > 0 then "
LF, FL = "list_transform(range(1, len(sur) + 1), lambda k: sur[k] || ', ' || ini[k])", "list_transform(range(1, len(sur) + 1), lambda k: ini[k] || ' ' || sur[k])"
CP = "list_transform(range(1, least(6, len(sur)) + 1), lambda k: sur[k] || ' ' || replace(replace(ini[k], '.', ''), ' ', ''))"
TEN = "list_transform(range(1, least(10, len(sur)) + 1), lambda k: sur[k] || ', ' || replace(ini[k], ' ', ''))"
LEAD = f"{HAS} case when len(sur) = 1 then {LF}[1] || '.' when len(sur) > 3 then {LF}[1] || ', et al.' else {LF}[1] || ', and ' || array_to_string({FL}[2:], ', and ') || '.' end end"


def _six(end: str) -> str:
    return f"{HAS} array_to_string({CP}, ', ') || case when len(sur) > 6 then '{end}' else '' end || '.' end"


def _joined(xs: str, last: str, end: str) -> str:
    return f"{HAS} case when len(sur) = 1 then ({xs})[1] || '{end}' else array_to_string(({xs})[:len(sur) - 1], ', ') || '{last}' || ({xs})[len(sur)] || '{end}' end end"


APA = f"{HAS} case when len(sur) > 20 then array_to_string(({LF})[:19], ', ') || ', ... ' || ({LF})[len(sur)] || '.' else {_joined(LF, ', & ', '.')} end end"
IEEE_TAIL = f"""'"' || title || ',"', jr || ',', {VN}, 'pp. ' || pg || ',', yr || '.'"""
NATURE = f"idx || '.', {HAS} array_to_string({TEN}, ', ') || case when len(sur) > 10 then ' et al.' else '' end end, title || '.', jr, nullif(concat_ws(', ', vol, pg, '(' || yr || ')'), '') || '.'"
LIST2 = f"list_concat([({LF})[1]], ({FL})[2:])"


def _sp(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(parts) + ")"


MARKERS = {
    1: {"apa": f"'(' || {_label(' & ', BOX)} || ', ' || {Y} || ')'", "vancouver": "'[' || idx || ']'", "ieee": "'[' || idx || ']'", "nature": "'[' || idx || ']'",
        "mla": f"'(' || case when len(sur) = 0 then {SHORT} else sur[1] end || ')'", "chicago": f"'(' || {_label(' and ', SHORT)} || ' ' || {Y} || ')'",
        "harvard": f"'(' || {_label(' and ', SHORT)} || ', ' || {Y} || ')'", "ama": SUP},
}
MARKERS[2] = MARKERS[1] | {"nature": SUP, "mla": f"'(' || case when len(sur) = 0 then {SHORT} when len(sur) = 1 then sur[1] else sur[1] || ' et al.' end || ')'", "harvard": f"'(' || {_label(' and ', BOX)} || ', ' || {Y} || ')'"}
VIY = f"list_filter([yr, {VI}, pg], lambda x: x is not null)"
PARTS = f"list_filter([jr, yr, {VI}, pg], lambda x: x is not null)"
ENTRIES = {
    1: {
        "apa": "regexp_replace(" + _sp(APA, f"'(' || {Y} || ').'", "title || '.'", JB, "doi") + ", '\\.{2,}', '.', 'g')",
        "vancouver": _sp("idx || '.'", _six(", et al."), "title || '.'", JB, "doi"),
        "ieee": _sp("'[' || idx || ']'", _joined(FL, " and ", ","), IEEE_TAIL, "doi || '.'"),
        "nature": _sp(NATURE, "doi"),
        "mla": _sp(LEAD, """'"' || title || '."'""", "'*' || jr || '*,'", VN, "yr || ','", "'pp. ' || pg || '.'", "doi"),
        "chicago": _sp(LEAD, "yr || '.'", """'"' || title || '."'""", "'*' || jr || '*'", "vol || coalesce(' (' || iss || ')', '') || ':'", "pg || '.'", "doi"),
        "harvard": "regexp_replace(" + _sp(f"{HAS} array_to_string(({LF})[:3], ' and ') || case when len(sur) > 3 then ' et al.' else '' end end", "'(' || yr || ')'", "'‘' || title || '’,'", "jr || ','", "'vol. ' || vol || ','", "'no. ' || iss || ','", "'pp. ' || pg || '.'", "doi") + ", ',\\s*\\.', '.', 'g')",
        "ama": _sp("idx || '.'", _six(", et al."), "title || '.'", "jr || '.'", f"case len({VIY}) when 3 then ({VIY})[1] || ';' || ({VIY})[2] || ':' || ({VIY})[3] || '.' when 2 then ({VIY})[1] || ';' || ({VIY})[2] || '.' when 1 then ({VIY})[1] || '.' end", "'doi:' || replace(doi, 'https://doi.org/', '')"),
    },
    2: {
        "apa": "regexp_replace(" + _sp(APA, f"'(' || {Y} || ').'", "title || '.'", JB, LINK) + ", '\\.{2,}', '.', 'g')",
        "vancouver": _sp("idx || '.'", _six(", et al."), "title || '.'", f"case len({PARTS}) when 4 then jr || ';' || yr || ';' || {VI} || ':' || pg || '.' when 0 then null else array_to_string({PARTS}, ', ') || '.' end", LDOI),
        "ieee": _sp("'[' || idx || ']'", _joined(FL, " and ", ","), IEEE_TAIL, f"({LDOI}) || '.'"),
        "nature": _sp(NATURE, LINK),
        "mla": _sp(f"{HAS} case when len(sur) > 3 then ({LF})[1] || ', et al.' else array_to_string({LIST2}, ', and ') || '.' end end", """'"' || title || '."'""", "jr || ',' || coalesce(' vol. ' || vol || ',' || coalesce(' no. ' || iss || ',', ''), '') || coalesce(' ' || yr || ',', '') || coalesce(' pp. ' || pg || '.', '')", LINK),
        "chicago": _sp(f"{HAS} case when len(sur) > 10 then ({LF})[1] || ', et al.' when len(sur) = 1 then ({LF})[1] || '.' else array_to_string(({LIST2})[:len(sur) - 1], ', ') || ', and ' || ({LIST2})[len(sur)] || '.' end end", f"{Y} || '.'", """'"' || title || '."'""", "jr || coalesce(' ' || vol || coalesce(', no. ' || iss, ''), '') || coalesce(' (' || yr || ')', '') || coalesce(': ' || pg, '') || '.'", f"'https://doi.org/' || ({LINK}) || '.'"),
        "harvard": _sp(_joined("sur", " and ", ","), f"'(' || {Y} || ').'", "'''' || title || ''','", f"jr || coalesce(', ' || {VI}, '') || coalesce(', pp. ' || pg, '') || '.'", f"'Available at: ' || ({LINK})"),
        "ama": _sp("idx || '.'", _six(", et al"), "title || '.'", f"jr || '.' || coalesce(' ' || yr, '') || coalesce(';' || {VI}, '') || coalesce(':' || pg, '') || '.'", f"'doi:' || ({LINK})"),
    },
}


def _sql(kinds: dict[str, str]) -> str:
    rows = " union all ".join(f"select doc_id, idx::int as idx, '{s}' as style, {e} as text from refs" for s, e in kinds.items())
    return f"with {REFERENCES_SQL} {rows}"


def _bibliography(rule: str, entry: str) -> str:
    return f"with {REFERENCES_SQL} select doc_id, 'References\n' || repeat('{rule}', 60) || '\n\n' || string_agg({entry}, '\n\n' order by idx) as bibliography from refs group by doc_id"


QUERIES = {f.__name__: f for f in (style_markers_first, style_markers_second, style_entries_first, style_entries_second, bibliography_first, bibliography_second)}
ORACLE_SQL = {
    "style_markers_first": _sql(MARKERS[1]), "style_markers_second": _sql(MARKERS[2]),
    "style_entries_first": _sql(ENTRIES[1]), "style_entries_second": _sql(ENTRIES[2]),
    "bibliography_first": _bibliography("=", ENTRIES[1]["vancouver"]), "bibliography_second": _bibliography("─", ENTRIES[2]["mla"]),
}
