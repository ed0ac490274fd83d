"""Style detector queries over documents, and SQL for the signals of single sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import ailang, webcheck
from ..sources.tables import table

CASES = (
    "It is important to note that this robust framework plays a crucial role in various modern systems.",
    "Furthermore, we may leverage a comprehensive approach that could often provide important and significant insights.",
    "In 2019 Martha Quimby measured 37.5% of samples [3, 4] near Lake Geneva.",
    "The results show the data and the data show the results of the study in the context of the research.",
)


def _sentence_signals(spark, sf_dir, d):
    s = d.select("doc_id", F.posexplode(webcheck.sentences(F.col("text"))).alias("pos", "text"))
    more = table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("doc_id"), F.posexplode(F.array(*[F.concat(F.lit(c), F.lit(" "), F.col("p_name")) for c in CASES])).alias("pos", "text"))
    out = ailang.sentence_signals(s.unionByName(more))
    return out.select("doc_id", "pos", "n", *[F.round(c, 6).alias(c) for c in ("phrase", "predictability", "genericity", "low_specificity")])


def ai_sentence_signals(spark, sf_dir):
    """SF-15 to SF-17, A-18, PF-15, TG-9: signals of single sentences, of documents and of composed ones."""
    return _sentence_signals(spark, sf_dir, table(spark, sf_dir, "documents"))


def ai_language_documents(spark, sf_dir):
    """Q-6, TG-4, TG-6, J-8, J-9, A-6, A-10, A-12, A-13, W-8, W-12, K-6, SF-18, IO-19."""
    d = ailang.documents(ailang.analysed(table(spark, sf_dir, "documents")))
    return d.select("doc_id", "overall_percent", "total_words", "ai_like_words", "sentence_count", "flagged_count", *ailang.SIGNALS, "summary")


def ai_language_paragraphs(spark, sf_dir):
    """A-11, K-4, W-11, SF-4."""
    p = ailang.paragraph_reports(ailang.analysed(table(spark, sf_dir, "documents")))
    return p.select("doc_id", "place", "paragraph", "percent", "word_count", "flagged", "tier", F.to_json("dominant").alias("dominant"))


def ai_language_locations(spark, sf_dir):
    """K-3, K-8, PF-16, W-11: over all turns of the conversations."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    return ailang.locations(ailang.analysed(c)).select("doc_id", "place", "line", "percent", "tier", F.array_join("reasons", "; ").alias("reasons"), "recommendation")


def _in(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


PHRASES = " + ".join(f"case when regexp_matches(low, {_q(p)}) then {w}::double else 0 end" for p, w, _ in V.STYLE_PHRASES)
SPLIT = "string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
QUERIES = {f.__name__: f for f in (ai_sentence_signals, ai_language_documents, ai_language_paragraphs, ai_language_locations)}
ORACLE_SQL = {
    "ai_sentence_signals": f"""with d as (select doc_id, list_filter(list_transform({SPLIT}, lambda x: trim(x)), lambda x: len(list_filter(string_split(x, ' '), lambda y: y <> '')) >= 12) as ss from documents
  union all select -p_partkey, [{', '.join(_q(c) + " || ' ' || p_name" for c in CASES)}] from part),
 s as (select doc_id, unnest(ss) as text, unnest(range(len(ss))) as pos from d),
 w as (select *, lower(text) as low, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'), lambda x: lower(x)) as w from s),
 f as (select *, len(w) as n, len(list_filter(w, lambda x: list_contains({_in(V.STYLE_COMMON)}, x))) as common, len(list_distinct(w)) / len(w) as div, list_sum(list_transform(w, lambda x: length(x))) / len(w) as avglen,
  len(list_filter(w, lambda x: list_contains({_in(V.STYLE_GENERIC)}, x))) as gen, len(list_filter(w, lambda x: list_contains({_in(V.STYLE_HEDGES)}, x))) as hed,
  len(list_filter(w, lambda x: not list_contains({_in(V.STYLE_STOPWORDS)}, x) and length(x) > 2)) as cont, len(regexp_extract_all(text, {_q(V.STYLE_SPECIFIC)})) as spec, len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{3,}}'))) as cap from w where len(w) >= 5)
 select doc_id, pos::int as pos, n::int as n, round({PHRASES} + case when list_contains({_in(V.STYLE_TRANSITIONS)}, w[1]) or w[1] || ' ' || w[2] in ('in addition', 'as a') then 0.08 else 0 end, 6)::double as phrase,
  round(greatest(0, least(1, common / n * 0.65 + (1 - div) * 0.25 + case when avglen < 5.2 then 0.1 else 0 end)), 6)::double as predictability,
  round(greatest(0, least(1, gen / n * 3.4 + case when hed >= 2 then 0.12 else 0 end)), 6)::double as genericity,
  round(greatest(0, least(1, 1 - least(1, spec * 0.35 + cap * 0.08 + cont / n * 0.65))), 6)::double as low_specificity from f""",
}
