"""Queries over files and answers that are made from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, metadata
from ..sources import files
from ..sources.tables import table

#: What a document's number makes of it: plain text, a word-processor document, text with other line breaks, a refused type.
KINDS = ("txt", "docx", "TXT", "rtf")


def _made(spark, sf_dir):
    """(path, content) of files with the documents' texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS)).cast("int"))
    content = F.when(kind == "docx", files.as_docx(F.when(kind == "docx", F.col("text")))).when(kind == "TXT", F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary")).otherwise(F.col("text").cast("binary"))
    return d.select(F.concat(F.lit("in/"), "doc_id", F.lit("."), kind).alias("path"), content.alias("content"))


def files_read(spark, sf_dir):
    """IO-1, IO-2, IO-4, IO-6: files of all kinds, as texts or as failures of their own."""
    return files.parsed(_made(spark, sf_dir)).select("path", "ext", "text", F.col("error").isNotNull().alias("failed"))


def zips_read(spark, sf_dir):
    """IO-8: a batch a document, with its file, a hidden copy and a file of another type."""
    m = _made(spark, sf_dir)
    zips = m.select(F.concat("path", F.lit(".zip")).alias("path"), files.as_zip(F.array(F.substring("path", 4, 100), F.concat(F.lit("__MACOSX/"), F.substring("path", 4, 100)), F.lit("note.md")), F.array("content", "content", "content")).alias("content"))
    return files.unzipped(zips).select("path", "ext", "text", F.col("error").isNotNull().alias("failed"))


def pubmed_records(spark, sf_dir):
    """SF-9, IO-13: every part as a work, asked for by a number in some text."""
    p = table(spark, sf_dir, "part")
    ids = F.array(F.struct(F.lit("pubmed").alias("idtype"), F.col("p_partkey").cast("string").alias("value")), F.struct(F.lit("doi").alias("idtype"), F.concat(F.lit("10.3/"), "p_partkey").alias("value")))
    work = F.struct(F.col("p_name").alias("title"), F.concat((1990 + F.col("p_partkey") % 30).cast("string"), F.lit(" Jan 5")).alias("pubdate"), F.col("p_brand").alias("source"), F.col("p_size").cast("string").alias("volume"), F.lit("").alias("issue"), F.lit("1-9").alias("pages"), F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"), F.when(F.col("p_partkey") % 2 == 0, ids).otherwise(F.slice(ids, 1, 1)).alias("articleids"))
    catalog = p.select(F.col("p_partkey").cast("string").alias("pmid"), F.to_json(work).alias("json"))
    wanted = p.select(F.concat(F.lit("PMID: "), "p_partkey").alias("pmid"))
    return metadata.fetched(wanted, catalog, "pmid").select("pmid", F.array_join("record.authors", ";").alias("authors"), "record.year", "record.title", "record.journal", "record.volume", "record.issue", "record.pages", "record.doi", "record.raw")


def records_merged(spark, sf_dir):
    """SF-11: records with gaps, filled from others."""
    p = table(spark, sf_dir, "part")
    known = F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("journal"), F.lit(None).cast("string").alias("volume"))
    more = F.struct(F.concat(F.lit(" more "), "p_name").alias("title"), F.lit("J").alias("journal"), F.col("p_size").cast("string").alias("volume"))
    return p.select("p_partkey", metadata.merged(known, more, ("title", "journal", "volume")).alias("r")).select("p_partkey", "r.*")


def _answers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ref = F.concat(F.lit('{"authors": [" '), "p_type", F.lit(' A", ""], "year": '), (1990 + F.col("p_partkey") % 30).cast("string"), F.lit(', "title": "'), "p_name", F.lit('", "journal": "  ", "style": "APA"}'))
    items = F.concat(F.lit('[{"sentence": " '), "p_name", F.lit(' ", "reason": "'), F.repeat(F.col("p_type"), F.lit(20)), F.lit('", "confidence": "HIGH"}, {"sentence": "x", "reason": "y", "confidence": "low"}, {"sentence": "no reason"}, {"sentence": "s", "reason": "r"}]'))
    form = F.col("p_partkey") % 5
    text = F.when(form == 0, F.concat(F.lit("```json\n"), ref, F.lit("\n```"))).when(form == 1, F.concat(F.lit("Here it is: "), ref, F.lit(" as asked."))).when(form == 2, items).when(form == 3, F.concat(F.lit("Found "), items)).otherwise("no JSON here")
    return p.select("p_partkey", text.alias("answer"))


def answers_json(spark, sf_dir):
    """SF-10."""
    return _answers(spark, sf_dir).select("p_partkey", metadata.json_in(F.col("answer")).alias("json"))


def answers_sanitised(spark, sf_dir):
    """SF-12."""
    a = _answers(spark, sf_dir)
    r = answers.reference(F.col("answer"))
    listed = F.transform(answers.suggestions(F.col("answer")), lambda x: F.concat_ws("|", x["sentence"], x["reason"], x["confidence"]))
    return a.select("p_partkey", r.alias("r"), F.array_join(listed, ";").alias("suggestions"), answers.style(F.col("answer"))["style"].alias("style")).select("p_partkey", F.array_join("r.authors", ";").alias("authors"), "r.year", "r.title", "r.journal", "suggestions", "style")


QUERIES = {f.__name__: f for f in (files_read, zips_read, pubmed_records, records_merged, answers_json, answers_sanitised)}

KIND = "['txt', 'docx', 'TXT', 'rtf'][doc_id % 4 + 1]"
FILES = rf"""m as (select doc_id, {KIND} as kind, coalesce(text, '') as x from documents),
 f as (select 'in/' || doc_id || '.' || kind as path, lower(kind) as ext, kind = 'rtf' or not regexp_matches(x, '[^\s\x0B\x1C-\x1F\x85\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]') as failed, doc_id, kind,
   regexp_replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') as text from m)"""
REF = """'{"authors": [" ' || p_type || ' A", ""], "year": ' || (1990 + p_partkey % 30) || ', "title": "' || p_name || '", "journal": "  ", "style": "APA"}'"""
ITEMS = """'[{"sentence": " ' || p_name || ' ", "reason": "' || repeat(p_type, 20) || '", "confidence": "HIGH"}, {"sentence": "x", "reason": "y", "confidence": "low"}, {"sentence": "no reason"}, {"sentence": "s", "reason": "r"}]'"""
ORACLE_SQL = {
    "files_read": f"with {FILES} select path, ext, case when not failed then text end as text, failed from f",
    "zips_read": f"with {FILES} select path || '.zip!' || substr(path, 4) as path, ext, case when not failed then text end as text, failed from f where kind <> 'rtf'",
    "pubmed_records": "select 'PMID: ' || p_partkey as pmid, p_type as authors, (1990 + p_partkey % 30)::varchar as year, p_name as title, p_brand as journal, p_size::varchar as volume, null::varchar as issue, '1-9' as pages, case when p_partkey % 2 = 0 then 'https://doi.org/10.3/' || p_partkey end as doi, p_type || '. (' || (1990 + p_partkey % 30) || '). ' || p_name || '. ' || p_brand || '. ' || p_size || '. 1-9' || case when p_partkey % 2 = 0 then '. https://doi.org/10.3/' || p_partkey else '' end as raw from part",
    "records_merged": "select p_partkey, case when p_partkey % 2 = 0 then p_name else 'more ' || p_name end as title, case when p_partkey % 3 = 0 then 'J' else p_brand end as journal, p_size::varchar as volume from part",
    "answers_json": f"select p_partkey, case when p_partkey % 5 < 2 then {REF} when p_partkey % 5 < 4 then {ITEMS} end as json from part",
    "answers_sanitised": f"""select p_partkey, case when p_partkey % 5 < 2 then p_type || ' A' end as authors, case when p_partkey % 5 < 2 then (1990 + p_partkey % 30)::varchar end as year, case when p_partkey % 5 < 2 then p_name end as title, null::varchar as journal,
  case when p_partkey % 5 in (2, 3) then p_name || '|' || substr(repeat(p_type, 20), 1, 200) || '|high;s|r|medium' else '' end as suggestions, case when p_partkey % 5 < 2 then 'APA' end as style from part""",
}
