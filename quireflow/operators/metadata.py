"""Reference records from metadata services and BibTeX; the services' answers come as JSON strings in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

CROSSREF = (
    "struct<DOI:string,title:array<string>,`container-title`:array<string>,volume:string,issue:string,page:string,author:array<struct<family:string,given:string>>,"
    "published:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>>"
)
PUBMED = "struct<title:string,pubdate:string,source:string,volume:string,issue:string,pages:string,authors:array<struct<name:string>>,articleids:array<struct<idtype:string,value:string>>>"
HOST = "https://doi.org/"


def some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_doi(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^https?://doi\.org/", ""), r"(?i)^doi:\s*", ""))


def clean_pmid(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _authors(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, 3), "; "), F.when(F.size(names) > 3, " et al.").otherwise("")))


def _issue(volume: Column, issue: Column) -> Column:
    return F.concat(some(volume), F.coalesce(F.concat(F.lit("("), some(issue), F.lit(")")), F.lit("")))


def crossref(json: Column) -> Column:
    """Record of one work, null for an empty one."""
    x = F.from_json(json, CROSSREF)
    names = F.filter(F.transform(F.coalesce(x["author"], F.array()), lambda a: F.concat(some(a["family"]), F.coalesce(F.concat(F.lit(", "), some(a["given"])), F.lit("")))), lambda n: n.isNotNull())
    date = F.coalesce(x["published"], x["published-print"], x["published-online"])["date-parts"]
    year, title, journal = F.get(F.get(date, F.lit(0)), F.lit(0)).cast("string"), F.get(x["title"], F.lit(0)), F.get(x["container-title"], F.lit(0))
    doi = F.concat(F.lit(HOST), some(x["DOI"]))
    raw = F.concat_ws(" ", _authors(names), F.concat(F.lit("("), year, F.lit(")")), F.concat(some(title), F.lit(".")), some(journal), _issue(x["volume"], x["issue"]), some(x["page"]), doi)
    return F.struct(names.alias("authors"), year.alias("year"), title.alias("title"), journal.alias("journal"), some(x["volume"]).alias("volume"), some(x["issue"]).alias("issue"), some(x["page"]).alias("pages"), doi.alias("doi"), raw.alias("raw"), F.lit("crossref").alias("source"))


def pubmed(json: Column, pmid: Column) -> Column:
    x = F.from_json(json, PUBMED)
    names = F.filter(F.transform(F.coalesce(x["authors"], F.array()), lambda a: some(a["name"])), lambda n: n.isNotNull())
    year = some(F.regexp_extract(x["pubdate"], r"\b(?:19|20)\d{2}\b", 0))
    doi = F.concat(F.lit(HOST), F.get(F.filter(F.coalesce(x["articleids"], F.array()), lambda a: a["idtype"] == "doi"), F.lit(0))["value"])
    raw = F.concat_ws(". ", _authors(names), F.concat(F.lit("("), year, F.lit(")")), some(x["title"]), some(x["source"]), _issue(x["volume"], x["issue"]), some(x["pages"]), doi)
    return F.struct(names.alias("authors"), year.alias("year"), x["title"].alias("title"), x["source"].alias("journal"), some(x["volume"]).alias("volume"), some(x["issue"]).alias("issue"), some(x["pages"]).alias("pages"), doi.alias("doi"), pmid.alias("pmid"), raw.alias("raw"), F.lit("pubmed").alias("source"))


def fetched(wanted: DataFrame, catalog: DataFrame, key: str = "doi") -> DataFrame:
    """Records of a catalog (key, json) for wanted keys; a left join on the cleaned key."""
    clean = clean_doi if key == "doi" else clean_pmid
    w = wanted.withColumn("wanted_key", F.lower(clean(F.col(key))))
    c = catalog.select(F.lower(clean(F.col(key))).alias("wanted_key"), "json")
    found = w.join(c, "wanted_key", "left")
    record = crossref(F.col("json")) if key == "doi" else pubmed(F.col("json"), clean_pmid(F.col(key)))
    return found.select(*wanted.columns, F.when(F.col("json").isNotNull(), record).alias("record"))


def search(queries: DataFrame, catalog: DataFrame, limit: int = 5) -> DataFrame:
    """The works of a catalog (work_id, title) that share most words with a query (query_id, query): a token-overlap ranking."""
    def words(c: Column) -> Column:
        return F.array_distinct(F.split(strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " "))

    q = queries.select("query_id", F.explode(words(F.col("query"))).alias("w"))
    hits = q.join(catalog.select("work_id", F.explode(words(F.col("title"))).alias("w")), "w").groupBy("query_id", "work_id").agg(F.count("*").alias("shared"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("shared"), "work_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= limit)


def merged(known: Column, more: Column, fields: tuple[str, ...]) -> Column:
    """The first record with its missing fields filled from the second."""
    return F.struct(*[F.coalesce(some(known[f]), some(strip(more[f]))).alias(f) for f in fields])


def bibtex(c: Column) -> Column:
    """Array of records of the entries of a BibTeX text that have a title or authors."""
    def value(entry: Column, key: str) -> Column:
        return some(strip(F.regexp_extract(entry, rf'(?i){key}\s*=\s*[{{"]([^}}"]+)[}}"]', 1)))

    def record(e: Column) -> Column:
        authors = F.coalesce(F.transform(F.split(value(e, "author"), r"(?i)\s+and\s+"), strip), F.array().cast("array<string>"))
        title, year = value(e, "title"), value(e, "year")
        raw = F.concat(F.coalesce(F.get(authors, F.lit(0)), F.lit("")), F.lit(" ("), F.coalesce(year, F.lit("n.d.")), F.lit("). "), F.coalesce(title, F.lit("")), F.lit("."))
        pages = F.regexp_replace(F.coalesce(value(e, "pages"), F.lit("")), "^(.*?)--", "$1-")
        return F.struct(authors.alias("authors"), year.alias("year"), title.alias("title"), F.coalesce(value(e, "journal"), value(e, "booktitle")).alias("journal"), value(e, "volume").alias("volume"), pages.alias("pages"), F.concat(F.lit(HOST), value(e, "doi")).alias("doi"), raw.alias("raw"))

    entries = F.transform(F.regexp_extract_all(c, F.lit(r"(@\w+\s*\{[^@]+)"), F.lit(1)), record)
    return F.filter(entries, lambda r: r["title"].isNotNull() | (F.size(r["authors"]) > 0))


def first_of_equal(refs: DataFrame, pos: str = "pos", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """References without later ones of the same first surname, year, start of title and DOI."""
    key = F.concat_ws("|", F.coalesce(F.trim(F.lower(F.substring_index(F.get("authors", F.lit(0)), ",", 1))), F.lit("")), F.coalesce("year", F.lit("")), F.substring(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"\s+", " "), 1, 40), F.coalesce("doi", F.lit("")))
    return refs.withColumn("same", F.row_number().over(W.partitionBy(*by, key).orderBy(pos))).where("same = 1").drop("same")


def json_in(c: Column) -> Column:
    """The JSON text within an answer: fences removed, else the first object or array; null if there is none."""
    clean = strip(F.regexp_replace(F.regexp_replace(c, r"```(?:json)?\s*", ""), "```", ""))

    def valid(x: Column) -> Column:
        """The parser stops behind the first value; as the one element of a list, it must be all there is."""
        only = F.concat(F.lit("["), x, F.lit("]"))
        return F.when((F.trim(x) != "") & F.try_variant_get(F.try_parse_json(only), "$[0]", "variant").isNotNull() & F.try_variant_get(F.try_parse_json(only), "$[1]", "variant").isNull(), x)

    return F.coalesce(valid(clean), valid(some(F.regexp_extract(clean, r"(?s)\{.*\}", 0))), valid(some(F.regexp_extract(clean, r"(?s)\[.*\]", 0))))
