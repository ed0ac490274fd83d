"""Overlap queries over documents and benchmark passages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import OVERLAP_STOPWORDS
from ..operators import overlap
from ..sources.tables import table


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def plagiarism_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-3, A-8, A-9, J-15, W-3, PF-12."""
    return _found(spark, sf_dir).select("doc_id", "chunk", "word_start", "word_end", "source", "source_chunk", F.round("jaccard", 6).alias("jaccard"), F.round("cosine", 6).alias("cosine"), F.array_join("phrases", "|").alias("phrases"), "risk")


def plagiarism_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14, W-5, PF-13."""
    out = overlap.summary(table(spark, sf_dir, "documents"), _found(spark, sf_dir))
    return out.withColumn("similarity", F.round("similarity", 6))


def plagiarism_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15."""
    return overlap.by_source(_found(spark, sf_dir))


def plagiarism_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM-18, K-5, IO-9."""
    found = _found(spark, sf_dir)
    return overlap.reports(overlap.summary(table(spark, sf_dir, "documents"), found), found)


def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TG-7, TG-8, TG-10, TG-16, SF-1, SF-5: windows of every document with counts of what they hold."""
    d = overlap.profiled(overlap.chunks(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return d.select("doc_id", "chunk", "word_start", "word_end", F.md5("normal").alias("normal_md5"), F.size("shingles").alias("n_shingles"), F.size("content").alias("n_content"), F.size(T.rare_phrases(F.col("w"), OVERLAP_STOPWORDS)).alias("n_phrases"), T.preview(F.col("text")).alias("preview"))


STOP = "[" + ", ".join(f"'{w}'" for w in OVERLAP_STOPWORDS) + "]"


def _chunks_sql(table_name: str, key: str) -> str:
    return f"""
    select {key}, row_number() over (partition by {key} order by i) - 1 as chunk, i as word_start, least(i + 60, len(w)) as word_end,
           array_to_string(w[i + 1:i + 60], ' ') as text
    from (select {key}, w, unnest(range(0, len(w) + 1, 40)) as i
          from (select {key}, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from {table_name}))
    where len(w) - i >= 10"""


def _profile_sql(name: str) -> str:
    return f"""
    select *, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [] end) as shingles,
           list_filter(w, lambda x: not list_contains({STOP}, x) and length(x) > 2) as content,
           list_sort(list_distinct(case when len(w) >= 6 then list_transform(list_filter(range(1, len(w) - 4),
               lambda i: len(list_filter(w[i:i + 5], lambda x: not list_contains({STOP}, x))) >= 2), lambda i: array_to_string(w[i:i + 5], ' ')) else [] end)) as phrases
    from (select *, list_filter(string_split(normal, ' '), lambda x: x <> '') as w
          from (select *, trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as normal from {name}))"""


MATCHES = f"""
with dc as ({_chunks_sql('documents', 'doc_id')}), sc as ({_chunks_sql('benchmark', 'item_id')}),
d as ({_profile_sql('dc')}), s as ({_profile_sql('sc')}),
shared as (select a.doc_id, a.chunk, b.item_id, b.chunk as source_chunk, count(*) as n
  from (select doc_id, chunk, unnest(shingles) as g from d) a join (select item_id, chunk, unnest(shingles) as g from s) b using (g) group by all),
near as (select sh.*, n / (len(d.shingles) + len(s.shingles) - n) as j, d.word_start, d.word_end, d.content as dcont, s.content as scont, d.phrases as p, s.normal as snorm
  from shared sh join d on d.doc_id = sh.doc_id and d.chunk = sh.chunk join s on s.item_id = sh.item_id and s.chunk = sh.source_chunk),
scored as (select *, list_filter(p, lambda x: contains(snorm, x)) as hits,
  case when len(dcont) = 0 or len(scont) = 0 then 0 else
   list_sum(list_transform(list_intersect(dcont, scont), lambda t: len(list_filter(dcont, lambda y: y = t)) * len(list_filter(scont, lambda y: y = t))))
   / sqrt(list_sum(list_transform(list_distinct(dcont), lambda t: len(list_filter(dcont, lambda y: y = t)) ** 2)) * list_sum(list_transform(list_distinct(scont), lambda t: len(list_filter(scont, lambda y: y = t)) ** 2))) end as c0
  from near where j >= 0.125),
best as (select *, coalesce(c0, 0) as c from scored where j >= 0.25 or coalesce(c0, 0) >= 0.6 or len(hits) > 0
  qualify row_number() over (partition by doc_id, chunk order by j desc, item_id, source_chunk) = 1),
found as (select *, case when j >= 0.6 then 'HIGH' when j >= 0.25 or c >= 0.7 then 'MEDIUM' when len(hits) > 0 then 'LOW' else 'NONE' end as risk from best),
m as (select * from found where risk <> 'NONE')
"""

QUERIES = {f.__name__: f for f in (plagiarism_matches, plagiarism_summary, plagiarism_by_source, plagiarism_report, word_windows)}
ORACLE_SQL = {
    "plagiarism_matches": MATCHES + """select doc_id, chunk::int as chunk, word_start::int as word_start, word_end::int as word_end, item_id as source, source_chunk::int as source_chunk,
  round(j, 6) as jaccard, round(c, 6) as cosine, array_to_string(hits, '|') as phrases, risk from m""",
    "plagiarism_summary": MATCHES + """, f as (select doc_id, count(*) as n_matches, count(distinct w) as flagged from (select doc_id, chunk, unnest(range(word_start, word_end)) as w from m) group by 1),
  g as (select doc_id, count(*) as n from m group by 1),
  t as (select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words from documents),
  u as (select t.doc_id, words, coalesce(flagged, 0) as flagged, coalesce(g.n, 0) as n_matches, case when words = 0 then 0.0 else least(100.0, 100.0 * coalesce(flagged, 0) / words) end as similarity from t left join f using (doc_id) left join g using (doc_id))
  select doc_id, words, flagged, n_matches, round(similarity, 6)::double as similarity, case when similarity >= 30 then 'HIGH RISK' when similarity >= 10 then 'MEDIUM RISK' when similarity >= 3 then 'LOW RISK' else 'LIKELY ORIGINAL' end as label from u""",
    "plagiarism_by_source": MATCHES + "select item_id as source, count(*) filter (risk = 'HIGH') as high, count(*) filter (risk = 'MEDIUM') as medium, count(*) filter (risk = 'LOW') as low from m group by 1",
    "word_windows": f"""with dc as ({_chunks_sql('documents', 'doc_id')}), d as ({_profile_sql('dc')})
  select doc_id, chunk::int as chunk, word_start::int as word_start, word_end::int as word_end, md5(normal) as normal_md5, len(shingles)::int as n_shingles, len(content)::int as n_content, len(phrases)::int as n_phrases,
  array_to_string(string_split(text, ' ')[1:15], ' ') || case when len(string_split(text, ' ')) > 15 then '...' else '' end as preview from d""",
}
