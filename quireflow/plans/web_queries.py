"""Web-check, metadata and difference queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import OVERLAP_STOPWORDS
from ..operators import diffs, metadata, webcheck
from ..operators.styles import FIRST
from ..sources.tables import table
from .manuscripts import REFERENCES_SQL, references
from .style_queries import MARKERS


def page_texts(spark, sf_dir):
    """IO-16."""
    return table(spark, sf_dir, "pages").select("page_id", webcheck.page_text(F.col("html")).alias("text"))


def web_phrases(spark, sf_dir):
    """TG-5, A-20, W-10, K-7, PF-18."""
    return webcheck.queries(table(spark, sf_dir, "documents")).select("doc_id", "phrase")


def web_check(spark, sf_dir):
    """J-14, PF-14, Q-5, IO-15."""
    return webcheck.check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")).select("doc_id", "pos", "page_id", "risk", F.round("jaccard", 6).alias("jaccard"))


def doi_cleaned(spark, sf_dir):
    """SF-7, SF-13."""
    return references(spark, sf_dir).select("doc_id", F.col("index").alias("idx"), metadata.clean_doi(F.col("doi")).alias("doi"), F.md5("raw").alias("cache_key"))


def _catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    work = F.struct(F.concat(F.lit("10.1000/"), "p_partkey").alias("DOI"), F.array("p_name").alias("title"), F.array("p_brand").alias("container-title"), F.col("p_size").cast("string").alias("volume"), F.array(F.struct(F.col("p_type").alias("family"), F.lit("A").alias("given"))).alias("author"), F.struct(F.array(F.array((1990 + F.col("p_partkey") % 30).cast("int"))).alias("date-parts")).alias("published"))
    return p.select(F.concat(F.lit("10.1000/"), "p_partkey").alias("doi"), F.to_json(work).alias("json"))


def crossref_records(spark, sf_dir):
    """SF-8, IO-12."""
    wanted = references(spark, sf_dir).select("doc_id", F.col("index").alias("idx"), "doi")
    return metadata.fetched(wanted, _catalog(spark, sf_dir)).select("doc_id", "idx", F.array_join("record.authors", ";").alias("authors"), "record.year", "record.title", "record.journal", "record.raw")


def bibtex_records(spark, sf_dir):
    """IO-18, TG-15."""
    p = table(spark, sf_dir, "part")
    text = F.format_string("@article{k%d, author = {%s and B, C}, title = {%s}, year = {%d}, pages = {1--%d}, doi = {10.1/%d}}", "p_partkey", "p_type", "p_name", 1990 + F.col("p_partkey") % 30, "p_size", "p_partkey")
    out = p.select("p_partkey", F.inline(metadata.bibtex(text)))
    return out.select("p_partkey", F.array_join("authors", ";").alias("authors"), "year", "title", "pages", "doi", "raw")


def references_deduplicated(spark, sf_dir):
    """W-10: first references of equal key across the corpus of one title word."""
    r = references(spark, sf_dir).withColumn("pos", F.struct("doc_id", "index"))
    return metadata.first_of_equal(r, "pos", ("journal",)).groupBy("journal").agg(F.count("*").alias("n"))


def diff_html(spark, sf_dir):
    """IO-10, PF-20."""
    r = references(spark, sf_dir)
    return r.select("doc_id", F.col("index").alias("idx"), diffs.marked_html(F.concat(F.lit("See <it> & "), FIRST.marker("apa"), F.lit(" "), FIRST.marker("ieee"))).alias("html"))


def diff_lines(spark, sf_dir):
    """SF-28."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.inline(diffs.line_diff(F.col("text"), F.regexp_replace("text", r"(?m)^The ", "The [1] ")))).select("doc_id", "line", "original", "cited")


def diff_words(spark, sf_dir):
    """SF-27, W-9: words that a marker was put behind."""
    d = table(spark, sf_dir, "documents")
    chunks = diffs.word_diff(F.col("text"), F.regexp_replace("text", r"\. ", ". [1] "))
    return d.select("doc_id", F.posexplode(chunks).alias("pos", "c")).select("doc_id", "pos", "c.*")


STOP = "[" + ", ".join(f"'{w}'" for w in OVERLAP_STOPWORDS) + "]"
QUERIES = {f.__name__: f for f in (page_texts, web_phrases, web_check, doi_cleaned, crossref_records, bibtex_records, references_deduplicated, diff_html, diff_lines, diff_words)}
SEEN = f"replace(replace(replace(replace(replace('See <it> & ' || {MARKERS[1]['apa']} || ' ' || {MARKERS[1]['ieee']}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
ORACLE_SQL = {
    "diff_html": f"with {REFERENCES_SQL} select doc_id, idx::int as idx, regexp_replace({SEEN}, '{diffs.MARKS}', '<mark class=\"cite\">\\1</mark>', 'g') as html from refs",
    "page_texts": "select page_id, substr(regexp_replace(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\\s+', ' ', 'g'), 1, 3000) as text from (select page_id, case when strlen(html) <= 15000 then html else left(html, n) || case when strlen(left(html, n)) < 15000 then chr(65533) else '' end end as h from (select *, case when strlen(html) > 15000 then list_max(list_filter(range(3750, 15001), lambda i: strlen(left(html, i)) <= 15000)) end as n from pages))",
    "web_phrases": f"""with s as (select doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) as pos from documents),
 w as (select doc_id, pos, list_filter(string_split(trim(s), ' '), lambda x: x <> '') as w from s),
 c as (select *, list_transform(w, lambda x: case when not list_contains({STOP}, trim(lower(x), '.,;:')) and length(x) > 3 then 1 else 0 end) as f from w where len(w) >= 12),
 g as (select doc_id, pos, w, i, list_sum(f[i:i + 8]) as score from (select *, unnest(range(1, len(w) - 7)) as i from c)),
 b as (select doc_id, pos, array_to_string(w[i:i + 8], ' ') as phrase from g qualify row_number() over (partition by doc_id, pos order by score desc, i) = 1),
 u as (select * from b qualify row_number() over (partition by doc_id, phrase order by pos) = 1)
 select doc_id, phrase from u qualify row_number() over (partition by doc_id order by pos) <= 20""",
    "doi_cleaned": f"with {REFERENCES_SQL} select doc_id, idx::int as idx, replace(doi, 'https://doi.org/', '') as doi, md5('raw ' || p) as cache_key from refs",
    "crossref_records": f"with {REFERENCES_SQL} select doc_id, idx::int as idx, p_type || ', A' as authors, case when p_name is not null then (1990 + p % 30)::varchar end as year, p_name as title, p_brand as journal, p_type || ', A (' || (1990 + p % 30) || ') ' || p_name || '. ' || p_brand || ' ' || p_size || ' https://doi.org/10.1000/' || p as raw from refs left join part on p = p_partkey and doi like 'http%'",
    "bibtex_records": "select p_partkey, p_type || ';B, C' as authors, (1990 + p_partkey % 30)::varchar as year, p_name as title, '1-' || p_size as pages, 'https://doi.org/10.1/' || p_partkey as doi, p_type || ' (' || (1990 + p_partkey % 30) || '). ' || p_name || '.' as raw from part",
    "references_deduplicated": f"with {REFERENCES_SQL} select jr as journal, count(distinct concat_ws('|', coalesce(trim(lower(string_split(authors[1], ',')[1])), ''), coalesce(yr, ''), substr(lower(coalesce(title, '')), 1, 40), coalesce(doi, ''))) as n from refs group by 1",
    "diff_lines": "select doc_id, i::int as line, string_split(text, chr(10))[i] as original, regexp_replace(string_split(text, chr(10))[i], '^The ', 'The [1] ') as cited from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents) where starts_with(string_split(text, chr(10))[i], 'The ') qualify row_number() over (partition by doc_id order by i) <= 30",
}
