"""Text overlap between documents and sources: word windows, shingle join, best match, flagged words.

Candidate pairs come from an equi-join on shared shingles, which loses none: a pair is of interest only at a Jaccard
coefficient of THRESHOLD / 2 or more, so it shares a shingle. Cosine and phrases are computed for surviving pairs only.
The source side is joined without a hint; the planner broadcasts it when its measured size allows, and splits frequent
shingles at run time otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import OVERLAP_STOPWORDS

SIZE, STEP, LEAST_WORDS, SHINGLE, PHRASE = 60, 40, 10, 5, 6
THRESHOLD, HIGH, COSINE_GATE, COSINE_MEDIUM = 0.25, 0.60, 0.60, 0.70


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Overlapping windows of words: (key, chunk, word_start, word_end, text); windows under LEAST_WORDS are left out."""
    w = df.select(F.col(key), T.words(F.col(text)).alias("w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w"), F.lit(STEP)), lambda i: F.size("w") - i >= LEAST_WORDS)
    cut = w.select(key, "w", F.posexplode(starts).alias("chunk", "word_start"))
    end = F.least(F.col("word_start") + SIZE, F.size("w"))
    return cut.select(key, "chunk", "word_start", end.alias("word_end"), F.array_join(F.slice("w", F.col("word_start") + 1, SIZE), " ").alias("text"))


def profiled(cut: DataFrame, key: str) -> DataFrame:
    """Chunks with their distinct shingles, normal text and content words."""
    cut = cut.withColumn("normal", T.normalise(F.col("text"))).withColumn("w", T.words(F.col("normal")))
    return cut.withColumn("shingles", T.shingles(F.col("w"), SHINGLE)).withColumn("content", T.content_words(F.col("w"), OVERLAP_STOPWORDS))


def cosine(a: Column, b: Column) -> Column:
    """Of term counts; the common divisor of each side cancels, so whole numbers do."""
    def count(words: Column, w: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == w)).cast("bigint")

    def squares(words: Column) -> Column:
        return F.aggregate(F.array_distinct(words), F.lit(0).cast("bigint"), lambda s, w: s + count(words, w) * count(words, w))

    dot = F.aggregate(F.array_intersect(a, b), F.lit(0).cast("bigint"), lambda s, w: s + count(a, w) * count(b, w))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(dot / F.sqrt(squares(a).cast("double") * squares(b).cast("double")))


def risk(jaccard: Column, cos: Column, phrases: Column) -> Column:
    return F.when(jaccard >= HIGH, "HIGH").when((jaccard >= THRESHOLD) | (cos >= COSINE_MEDIUM), "MEDIUM").when(F.size(phrases) > 0, "LOW").otherwise("NONE")


def matches(docs: DataFrame, sources: DataFrame, doc_id="doc_id", doc_text="text", source_id="item_id", source_text="text") -> DataFrame:
    """The best source chunk of every document chunk, where its risk is not NONE.

    Of equal coefficients the first source, then its first chunk, stands. The risk is judged after the choice: a best chunk
    without risk hides a weaker one with some.
    """
    d = profiled(chunks(docs, doc_id, doc_text), doc_id)
    s = profiled(chunks(sources, source_id, source_text), source_id).select(F.col(source_id).alias("source"), F.col("chunk").alias("source_chunk"), F.col("text").alias("source_text"), F.col("normal").alias("source_normal"), F.col("content").alias("source_content"), F.col("shingles").alias("source_shingles"))
    grams = d.select(doc_id, "chunk", F.size("shingles").alias("n_doc"), F.explode_outer("shingles").alias("gram"))
    source_grams = s.select("source", "source_chunk", F.size("source_shingles").alias("n_source"), F.explode_outer("source_shingles").alias("gram"))
    # the outer form keeps the planner from testing the array first, which would build all shingles once more; nulls don't join
    shared = grams.join(source_grams, "gram").groupBy(doc_id, "chunk", "source", "source_chunk").agg(F.count("*").alias("shared"), F.max("n_doc").alias("n_doc"), F.max("n_source").alias("n_source"))
    near = shared.withColumn("jaccard", F.col("shared") / (F.col("n_doc") + F.col("n_source") - F.col("shared"))).where(F.col("jaccard") >= THRESHOLD * 0.5)
    full = near.join(d.drop("shingles"), [doc_id, "chunk"]).join(s.drop("source_shingles"), ["source", "source_chunk"])
    full = full.withColumn("cosine", cosine(F.col("content"), F.col("source_content")))
    full = full.withColumn("phrases", F.filter(T.rare_phrases(F.col("w"), OVERLAP_STOPWORDS, PHRASE), lambda p: F.contains(F.col("source_normal"), p)))
    full = full.where((F.col("jaccard") >= THRESHOLD) | (F.col("cosine") >= COSINE_GATE) | (F.size("phrases") > 0))
    best = W.partitionBy(doc_id, "chunk").orderBy(F.desc("jaccard"), "source", "source_chunk")
    full = full.withColumn("place", F.row_number().over(best)).where("place = 1").withColumn("risk", risk(F.col("jaccard"), F.col("cosine"), F.col("phrases")))
    return full.where("risk <> 'NONE'").select(doc_id, "chunk", "word_start", "word_end", "source", "source_chunk", "jaccard", "cosine", "phrases", "risk", F.col("text").alias("chunk_text"), "source_text")


def summary(docs: DataFrame, found: DataFrame, doc_id="doc_id", doc_text="text") -> DataFrame:
    """Words, flagged words (the union of the matched windows), similarity in percent and risk of every document."""
    before = W.partitionBy(doc_id).orderBy("word_start", "word_end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("word_end").over(before), F.lit(0))
    parts = found.select(doc_id, "word_start", "word_end").withColumn("adds", F.greatest(F.lit(0), F.col("word_end") - F.greatest("word_start", reach)))
    flagged = parts.groupBy(doc_id).agg(F.sum("adds").alias("flagged"), F.count("*").alias("n_matches"))
    out = docs.select(doc_id, F.size(T.words(F.col(doc_text))).cast("bigint").alias("words")).join(flagged, doc_id, "left")
    out = out.select(doc_id, "words", F.coalesce("flagged", F.lit(0)).cast("bigint").alias("flagged"), F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"))
    share = F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.lit(100.0) * F.col("flagged") / F.col("words")))
    out = out.withColumn("similarity", share)
    return out.withColumn("label", F.when(F.col("similarity") >= 30, "HIGH RISK").when(F.col("similarity") >= 10, "MEDIUM RISK").when(F.col("similarity") >= 3, "LOW RISK").otherwise("LIKELY ORIGINAL"))


def by_source(found: DataFrame) -> DataFrame:
    """Matches of every source by risk."""
    out = found.groupBy("source").pivot("risk", ["HIGH", "MEDIUM", "LOW"]).agg(F.count(F.lit(1)))
    return out.select("source", *[F.coalesce(F.col(r), F.lit(0)).cast("bigint").alias(r.lower()) for r in ("HIGH", "MEDIUM", "LOW")])


def match_lines(found: DataFrame) -> Column:
    """The report text of a match."""
    phrases = F.when(F.size("phrases") > 0, F.concat(F.lit("\n    Shared phrases: "), F.array_join(F.transform(F.slice("phrases", 1, 3), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), "; "))).otherwise("")
    return F.concat(F.format_string("  [%s] Jaccard=%s Cosine=%s\n    Doc  : \"%s\"\n    Source (%s): \"%s\"", "risk", T.decimals(F.col("jaccard"), 2), T.decimals(F.col("cosine"), 2), T.preview(F.col("chunk_text")), F.col("source").cast("string"), T.preview(F.col("source_text"))), phrases)


#: What the report says about each label.
ADVICE = {
    "HIGH RISK": "\n  ⚠ HIGH RISK — Substantial portions of this document match\n  known sources. Review flagged passages before submission.",
    "MEDIUM RISK": "\n  ⚠ MEDIUM RISK — Some passages match known sources.\n  Check flagged sections and add proper citations if missing.",
    "LOW RISK": "\n  ℹ LOW RISK — Minor overlaps detected. Likely acceptable,\n  but review flagged phrases to confirm they are properly cited.",
    "LIKELY ORIGINAL": "\n  ✓ LIKELY ORIGINAL — No significant matches found in the\n  provided sources or web search.",
}


def reports(totals: DataFrame, found: DataFrame, doc_id="doc_id") -> DataFrame:
    """One report text for every document: head, advice, matches by source, greatest coefficient first within a source."""
    rule = "=" * 65
    lines = found.withColumn("line", match_lines(found)).groupBy(doc_id, "source").agg(
        F.min("chunk").alias("first"), *[F.count_if(F.col("risk") == r).alias(r) for r in ("HIGH", "MEDIUM", "LOW")],
        F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("j"), "chunk", "line"))).alias("lines"),
    )
    block = F.concat(F.format_string('\n  Source: "%s"\n  %d HIGH · %d MEDIUM · %d LOW risk matches\n\n', F.col("source").cast("string"), "HIGH", "MEDIUM", "LOW"), F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), "\n"))
    blocks = lines.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("first", block.alias("block"), F.col("source").cast("string").alias("source")))).alias("blocks"))
    out = totals.join(blocks, doc_id, "left")
    head = F.format_string(f"\n{rule}\n  PLAGIARISM CHECK REPORT\n  Document : %s\n{rule}\n  Overall similarity  : %s%%\n  Risk level          : %s\n  Document word count : %,d\n  Flagged word count  : %,d\n  Local matches found : %d", F.col(doc_id).cast("string"), T.decimals(F.col("similarity"), 1), "label", "words", "flagged", "n_matches")
    hit = F.when(F.size("blocks") > 0, F.concat(F.lit("\n  Sources matched     : "), F.array_join(F.transform("blocks", lambda b: b["source"]), ", "))).otherwise("")
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])[F.col("label")]
    body = F.when(F.size("blocks") > 0, F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")).otherwise("  No matches found.")
    return out.select(doc_id, F.concat(head, hit, F.lit(f"\n{rule}\n"), advice, F.lit("\n\n── LOCAL SOURCE MATCHES " + "─" * 41 + "\n"), body, F.lit(f"\n{rule}\n")).alias("report"))
