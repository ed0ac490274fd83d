"""Formulaic prose: seven signals of every sentence, a score, and roll-ups by paragraph and document.

Sentence signals are projections. Document signals are windows over the document. What a sentence shares with the others of
its text is counted where the text is split, over all pairs that share a word; no rows of pairs are made.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from .sentences import DETECTING, pieces

LEAST_WORDS, LEAST_TOTAL, FLAGGED = 5, 20, 0.48
SIGNALS = ("predictability", "rhythm_uniformity", "redundancy", "low_specificity", "style_contrast", "genericity")


def hits(words: Column, xs: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(xs)))


BLANK_LINE, NO_SPACE = re.compile(r"\n\s*\n", re.ASCII), re.compile(r"\S", re.ASCII)


def paragraph_starts(text: str) -> list[int]:
    """Where paragraphs between blank lines start, without white space before."""
    out, at = [], 0
    while first := NO_SPACE.search(text, at):
        out.append(first.start())
        if not (blank := BLANK_LINE.search(text, first.end())):
            break
        at = blank.end()
    return out


def places(text: str, starts: list[int]) -> tuple[list[int], list[int]]:
    """Line and paragraph, from 1, of every sentence by its start; between paragraphs, the one before. One pass over the text."""
    lines, at, line, paras = [], 0, 1, paragraph_starts(text)
    for start in starts:
        line += text.count("\n", at, start)
        at = start
        lines.append(line)
    return lines, [max(1, bisect_right(paras, start)) for start in starts]


WORD, STOPWORDS = re.compile("[A-Za-z][A-Za-z'-]*"), frozenset(V.STYLE_STOPWORDS)
#: Cells of a matrix of sentences and words; beyond, the sentences of each word are listed instead.
CELLS = 4_000_000
FOUND = "array<struct<text:string,start:int,end:int,line:int,paragraph:int,repeated:int,grams:int,overlap:double>>"


def greatest_overlaps(kinds: list[set[str]]) -> np.ndarray:
    """For every set, the greatest Jaccard coefficient with another one."""
    n, ids = len(kinds), {}
    cols = np.array([ids.setdefault(w, len(ids)) for k in kinds for w in k], np.int64)
    sizes = np.array([len(k) for k in kinds], np.int64)
    if n < 2 or not ids:
        return np.zeros(n)
    out, rows = np.zeros(n), np.repeat(np.arange(n), sizes)
    if n * len(ids) <= CELLS:
        held = np.zeros((n, len(ids)), np.float32)
        held[rows, cols] = 1
        for at in range(0, n, 256):
            both = (held[at : at + 256] @ held.T).astype(np.float64)
            both[np.arange(len(both)), np.arange(at, at + len(both))] = 0
            out[at : at + 256] = (both / np.maximum(1, sizes[at : at + 256, None] + sizes - both)).max(1)
        return out
    order = np.argsort(cols, kind="stable")
    by_word = np.split(rows[order], np.cumsum(np.bincount(cols))[:-1])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for i in np.flatnonzero(sizes):
        others, both = np.unique(np.concatenate([by_word[c] for c in cols[starts[i] : starts[i + 1]]]), return_counts=True)
        both[others == i] = 0
        out[i] = (both / (sizes[i] + sizes[others] - both)).max()
    return out


def repeats(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the sentences of a text: its phrases of two and three content words that others have, all of them, and the greatest overlap of content words.

    Sentences of fewer than LEAST_WORDS words do not count.
    """
    repeated, sizes, first, kinds, kept = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32), {}, [], []
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        if len(words) < LEAST_WORDS:
            continue
        content = [w for w in " ".join(words).lower().split(" ") if len(w) > 2 and w not in STOPWORDS]
        grams = {*zip(content, content[1:], strict=False), *zip(content, content[1:], content[2:], strict=False)}
        sizes[i] = len(grams)
        again = 0
        for g in grams:
            if (j := first.setdefault(g, i)) != i:
                again += 1
                if j >= 0:
                    repeated[j] += 1
                    first[g] = -1
        repeated[i] += again
        kinds.append(set(content))
        kept.append(i)
    overlap = np.zeros(len(texts))
    overlap[kept] = greatest_overlaps(kinds)
    return repeated, sizes, overlap


def found_sentences(c: Column) -> Column:
    """Array of (text, start, end, line, paragraph, repeated, grams, overlap)."""

    def run(texts: pa.Array) -> pa.Array:
        offsets, found, lines, paras, counts = [0], [], [], [], []
        for value in texts:
            text = value.as_py() or ""
            found += (own := pieces(text, DETECTING))
            for all_, new in zip((lines, paras), places(text, [p[1] for p in own]), strict=True):
                all_ += new
            counts.append(repeats([p[0] for p in own]))
            offsets.append(len(found))
        texts_, starts, ends = zip(*found, strict=True) if found else ((), (), ())
        numbers = [np.concatenate([x[k] for x in counts]) if counts else np.zeros(0) for k in range(3)]
        columns = [pa.array(texts_, pa.string()), *[pa.array(x, pa.int32()) for x in (starts, ends, lines, paras, numbers[0], numbers[1])], pa.array(numbers[2], pa.float64())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["text", "start", "end", "line", "paragraph", "repeated", "grams", "overlap"]))

    return F.arrow_udf(run, FOUND)(c)


def split_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, text, start, end, line, paragraph) of every sentence, and what it shares with others: repeated, grams, overlap."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    # outer: else a filter on the array's size has the texts split twice
    s = docs.select(doc_id, F.posexplode_outer(found_sentences(clean)).alias("pos", "s")).where("s is not null")
    return s.select(doc_id, "pos", "s.*")


def sentence_signals(s: DataFrame) -> DataFrame:
    """Adds words, content words, n, and the signals that a sentence shows by itself, with the reasons so far."""
    # counted first: a filter on the array's size has the words taken twice
    s = s.where(F.regexp_count("text", F.lit("[A-Za-z][A-Za-z'-]*")) >= LEAST_WORDS)
    s = s.withColumn("words", F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z][A-Za-z'-]*)"), F.lit(1)), F.lower))
    s = s.withColumns({"n": F.size("words"), "content": T.content_words(F.col("words"), V.STYLE_STOPWORDS), "lower": F.lower("text")})
    n = F.col("n")
    starts = F.get("words", F.lit(0)).isin(V.STYLE_TRANSITIONS) | F.concat_ws(" ", F.get("words", F.lit(0)), F.get("words", F.lit(1))).isin("in addition", "as a")
    phrase = F.lit(0.0)
    for pattern, weight, _ in V.STYLE_PHRASES:
        phrase = phrase + F.when(F.col("lower").rlike(pattern), weight).otherwise(0.0)
    phrase = phrase + F.when(starts, 0.08).otherwise(0.0)
    diversity = F.size(F.array_distinct("words")) / n
    length = F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)) / n
    generic, hedges = hits(F.col("words"), V.STYLE_GENERIC), hits(F.col("words"), V.STYLE_HEDGES)
    s = s.withColumns({"phrase": phrase, "diversity": diversity, "generic": generic, "hedges": hedges, "predictability": T.clamp(hits(F.col("words"), V.STYLE_COMMON) / n * 0.65 + (1 - diversity) * 0.25 + F.when(length < 5.2, 0.10).otherwise(0.0))})
    specific = F.regexp_count("text", F.lit(V.STYLE_SPECIFIC)) * 0.35 + F.regexp_count("text", F.lit(r"\b[A-Z][a-z]{3,}\b")) * 0.08 + F.size("content") / n * 0.65
    s = s.withColumns({"genericity": T.clamp(F.col("generic") / n * 3.4 + F.when(F.col("hedges") >= 2, 0.12).otherwise(0.0)), "low_specificity": T.clamp(1 - F.least(F.lit(1.0), specific))})
    reasons = [F.when(F.col("lower").rlike(p), r) for p, _, r in V.STYLE_PHRASES]
    reasons += [F.when(starts, "formal transition starter"), F.when(F.col("generic") >= 3, "generic academic vocabulary"), F.when(F.col("hedges") >= 2, "heavy hedging"), F.when((n >= 14) & (F.col("low_specificity") > 0.62), "low specificity for sentence length")]
    return s.withColumn("reasons", F.array_compact(F.array(*reasons))).drop("lower", "generic", "hedges")


def with_reason(condition: Column, reason: str) -> Column:
    return F.when(condition, F.concat("reasons", F.array(F.lit(reason)))).otherwise(F.col("reasons"))


def document_signals(s: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds rhythm and contrast; documents of fewer than LEAST_TOTAL words go."""
    doc, para = W.partitionBy(doc_id), W.partitionBy(doc_id, "paragraph")
    s = s.withColumn("total", F.sum("n").over(doc)).where(F.col("total") >= LEAST_TOTAL)
    s = s.withColumns({"mean_n": F.avg("n").over(doc), "sd_n": F.stddev_pop("n").over(doc), "mean_d": F.avg("diversity").over(doc), "sd_d": F.stddev_pop("diversity").over(doc), "para_cv": F.stddev_pop("n").over(para) / F.greatest(F.lit(1.0), F.avg("n").over(para))})
    sd = F.when(F.col("sd_n") == 0, 1.0).otherwise(F.col("sd_n"))
    whole = T.clamp(1 - sd / F.greatest(F.lit(1.0), F.col("mean_n")) / 0.85)
    near = 1 - F.least(F.abs(F.col("n") - F.col("mean_n")) / F.greatest(F.lit(1.0), sd * 2.5), F.lit(1.0))
    s = s.withColumn("rhythm_uniformity", T.clamp(whole * 0.45 + T.clamp(1 - F.col("para_cv") / 0.75) * 0.35 + near * 0.20))
    s = s.withColumn("reasons", with_reason((F.col("rhythm_uniformity") > 0.72) & (F.col("n") >= 12), "uniform sentence rhythm"))
    z = F.abs(F.col("diversity") - F.col("mean_d")) / F.when(F.col("sd_d") == 0, 0.01).otherwise(F.col("sd_d"))
    s = s.withColumn("z", z).withColumn("style_contrast", F.when(F.col("z") > 1.8, T.clamp((F.col("z") - 1.2) / 2.8)).when((F.col("predictability") > 0.55) & (F.col("rhythm_uniformity") > 0.65), 0.20).otherwise(0.0))
    return s.withColumn("reasons", with_reason(F.col("z") > 1.8, "style differs from document baseline")).drop("mean_n", "sd_n", "mean_d", "sd_d", "para_cv", "z")


def redundancy(s: DataFrame) -> DataFrame:
    """Adds redundancy: the share of phrases that other sentences have, and the greatest overlap of content words."""
    s = s.withColumn("redundancy", T.clamp(F.col("repeated") / F.greatest(F.lit(1), "grams") * 0.65 + F.col("overlap") * 0.55))
    return s.withColumn("reasons", with_reason(F.col("redundancy") > 0.40, "repeated concepts or phrasing")).drop("repeated", "grams", "overlap")


def tier(score: Column, high: float = 0.72, medium: float = FLAGGED) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def finished(s: DataFrame) -> DataFrame:
    """Adds the score and completes the reasons; below a score of .34 only the first two are kept."""
    n = F.col("n")
    factor = F.when(n < 10, 0.72).when(n >= 32, 1.08).otherwise(1.0)
    score = T.clamp((F.col("phrase") * 0.23 + F.col("predictability") * 0.20 + F.col("rhythm_uniformity") * 0.15 + F.col("redundancy") * 0.18 + F.col("low_specificity") * 0.14 + F.col("style_contrast") * 0.06 + F.col("genericity") * 0.14) * factor)
    s = s.withColumn("score", score).withColumn("reasons", with_reason(n >= 32, "long polished sentence")).withColumn("reasons", with_reason(F.col("predictability") > 0.58, "highly predictable wording"))
    return s.withColumn("reasons", F.when(F.col("score") < 0.34, F.slice("reasons", 1, 2)).otherwise(F.col("reasons"))).withColumn("tier", tier(F.col("score")))


def analysed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every kept sentence with its signals, score, tier and reasons, in the order of the text, so that sums over it agree."""
    s = document_signals(sentence_signals(split_documents(docs, doc_id, text)), doc_id)
    return finished(redundancy(s).sortWithinPartitions(doc_id, "pos"))


def recommendation(names: tuple = ()) -> Column:
    """Advice by the first rule that holds."""
    c = F.col
    return (F.when((c("low_specificity") >= 0.55) & (c("genericity") >= 0.25), "Add concrete evidence: source, data point, method name, or a specific example.")
            .when(c("redundancy") >= 0.45, "Check whether this repeats an earlier idea; merge or replace with new evidence.")
            .when((c("rhythm_uniformity") >= 0.70) & (c("predictability") >= 0.35), "Vary sentence structure and replace generic phrasing with author-specific wording.")
            .when(c("style_contrast") >= 0.35, "Review whether this passage matches the surrounding author voice.")
            .when(c("phrase") >= 0.20, "Replace template-like phrasing with a direct, specific claim.")
            .otherwise("Review for specificity and source grounding."))


def dominant(values: dict[str, Column], least: float, most: int = 3) -> Column:
    """The greatest signals that reach ``least``, as (name, percent); of equals the first."""
    ordered = F.array_sort(F.array(*[F.struct((-v).alias("minus"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, v) in enumerate(values.items())]))
    return F.transform(F.filter(F.slice(ordered, 1, most), lambda x: -x["minus"] >= least), lambda x: F.struct(x["name"].alias("name"), T.percent(-x["minus"]).alias("percent")))


def locations(s: DataFrame, doc_id: str = "doc_id", most: int = 100) -> DataFrame:
    """Sentences worth a look, the highest score first."""
    order = W.partitionBy(doc_id).orderBy(F.desc("score"), "pos")
    s = s.where((F.col("score") >= 0.22) | (F.size("reasons") > 0)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    signals = {n.replace("_", " "): F.col(n) for n in SIGNALS}
    return s.select(doc_id, "place", "pos", "line", "paragraph", "start", "end", F.col("n").alias("word_count"), T.percent(F.col("score")).alias("percent"), "tier", "text", F.slice("reasons", 1, 6).alias("reasons"), dominant(signals, 0.15).alias("dominant"), recommendation().alias("recommendation"), *[T.percent(F.col(n)).alias(n) for n in SIGNALS])


def paragraph_reports(s: DataFrame, doc_id: str = "doc_id", most: int = 30) -> DataFrame:
    """Roll-up of paragraphs of 15 words and more, the highest percent first."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "pos", "line", F.size("reasons").alias("k"), T.excerpt(F.col("text"), 170).alias("text")))), 1, 3)
    g = s.groupBy(doc_id, "paragraph").agg(F.sum("n").alias("word_count"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"), F.count_if(F.col("score") >= FLAGGED).alias("flagged"), *[F.avg(n).alias(n) for n in SIGNALS], top.alias("top"))
    g = g.where("word_count >= 15").withColumns({"percent": T.percent(F.col("score")), "tier": tier(F.col("score"), 0.65, 0.40), "dominant": dominant({n: F.col(n) for n in SIGNALS}, 0.12)})
    g = g.withColumn("top", F.transform(F.filter("top", lambda x: (-x["minus"] >= 0.18) | (x["k"] > 0)), lambda x: F.struct(x["line"].alias("line"), T.percent(-x["minus"]).alias("percent"), x["text"].alias("text"))))
    place = F.row_number().over(W.partitionBy(doc_id).orderBy(F.desc("percent"), "paragraph"))
    return g.withColumn("place", place).where(F.col("place") <= most).select(doc_id, "place", "paragraph", "percent", "word_count", "flagged", "tier", "dominant", "top")


def documents(s: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Percent, words, AI-like words, sentences, flagged sentences, signals, notes and summary of every document."""
    weighted = {n: T.percent(F.sum(F.col(n) * F.col("n")) / F.sum("n")).alias(n) for n in SIGNALS}
    d = s.groupBy(doc_id).agg(T.percent(F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("overall_percent"), F.sum("n").alias("total_words"), F.rint(F.sum(F.col("score") * F.col("n"))).cast("long").alias("ai_like_words"), F.count("*").alias("sentence_count"), F.count_if(F.col("score") >= FLAGGED).alias("flagged_count"), *weighted.values())
    notes = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("minus"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(text).alias("description")) for i, (n, text) in enumerate(V.STYLE_NOTES.items())]))
    notes = F.transform(notes, lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("percent"), x["description"].alias("description"), tier(-x["minus"], 65, 35).alias("severity")))
    part = F.concat(F.col("flagged_count"), F.lit("/"), F.col("sentence_count"), F.lit(" sentences."))
    p = F.col("overall_percent")
    summary = F.when(p >= 65, F.concat(F.lit("High AI-language signal across "), part)).when(p >= 40, F.concat(F.lit("Moderate AI-language signal across "), part)).when(F.col("flagged_count") > 0, F.concat(F.lit("Low overall signal, with "), F.col("flagged_count"), F.lit(" localized sentence(s) worth review."))).otherwise("Low AI-language signal.")
    return d.withColumns({"notes": notes, "summary": summary})
