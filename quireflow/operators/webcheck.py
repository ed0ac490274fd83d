"""Sentences against web pages, offline: a table of pages stands in for the search engine and the fetch.

A page is a hit of a sentence's search phrase if its normalised words hold those of the phrase in a row. To find these
without comparing every sentence with every page, both sides are joined on a hash of the phrase's first KEY_WORDS normalised
words, or of all if there are fewer, as normalising can leave any number of words; the whole phrase is then looked up on the
pages met, once for all sentences that ask for it. A phrase without letters and digits hits nothing.

A phrase of six words with two content words among them is one that its sentence shares with every page that holds it. So
the first such page is the sentence's match; only for other phrases all pages that hold them are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import OVERLAP_STOPWORDS

QUERIES, LEAST_WORDS, PHRASE_WORDS, GATE, HIGH, FETCH = 20, 12, 9, 0.20, 0.50, 3000
KEY_WORDS, SHINGLE = 6, 5


def page_text(html: Column, most: int = FETCH) -> Column:
    """Text of the first ``5 * most`` bytes without tags and entities, single spaces, cut to ``most`` characters.

    A character that the limit cuts in two is left out.
    """
    data, n = F.encode(html, "UTF-8"), most * 5

    def inside(at: int) -> Column:
        return F.hex(F.substring(data, at + 1, 1)).rlike("^[89AB]")

    cut = F.when(~inside(n), n).when(~inside(n - 1), n - 1).when(~inside(n - 2), n - 2).otherwise(n - 3)
    raw = F.decode(F.substring(data, F.lit(1), cut), "UTF-8")
    flat = T.single_spaces(F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), "&[a-z]+;", " "))
    return F.substring(flat, 1, most)


def title(html: Column) -> Column:
    return T.strip(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def sentences(c: Column) -> Column:
    """Split behind . ! ? before a capital; sentences of LEAST_WORDS words and more, between single spaces."""
    parts = F.transform(F.split(T.single_spaces(c), " (?<=[.!?] )(?=[A-Z])"), F.trim)
    return F.filter(parts, lambda p: F.size(F.split(p, " ")) >= LEAST_WORDS)


def phrase_start(w: Column, n: int = PHRASE_WORDS) -> Column:
    """Where, from 1, the n words in a row begin that hold most content words, the first of equals. Every word is looked up once."""
    def content(x: Column) -> Column:
        return (F.length(x) > 3) & ~F.btrim(F.lower(x), F.lit(".,;:")).isin(OVERLAP_STOPWORDS)

    def best(flags: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.struct(F.aggregate(F.slice(flags, i, n), F.lit(0), lambda a, x: a + x).alias("score"), (-i).alias("at")))
        return -F.array_max(windows)["at"]

    return F.when(F.size(w) >= n, T.let(F.transform(w, lambda x: content(x).cast("int")), best)).otherwise(F.lit(1))


def phrase_at(w: Column, at: Column, n: int = PHRASE_WORDS) -> Column:
    return F.array_join(F.slice(w, at, n), " ")


def query_phrase(sentence: Column, n: int = PHRASE_WORDS) -> Column:
    """The n words in a row that hold most content words, the first of equals; all words if there are fewer."""
    return T.let(T.words(sentence), lambda w: phrase_at(w, phrase_start(w, n), n))


def first_of_phrases(found: Column, most: int) -> Column:
    """Of an array of sentences the first ``most`` whose phrases differ, as (pos, sentence, at, phrase)."""
    kind = "struct<pos: int, found: array<struct<pos: int, sentence: string, at: int, phrase: string>>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().alias("found")).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        def added(x: Column) -> Column:
            known = F.exists(acc["found"], lambda y: y["phrase"] == x["phrase"])
            return F.struct((acc["pos"] + 1).alias("pos"), F.when(known, acc["found"]).otherwise(F.concat(acc["found"], F.array(x))).alias("found"))

        def of(w: Column) -> Column:
            return T.let(phrase_start(w), lambda at: added(F.struct(acc["pos"].alias("pos"), s.alias("sentence"), at.alias("at"), phrase_at(w, at).alias("phrase"))))

        return F.when(F.size(acc["found"]) >= most, acc).otherwise(T.let(F.split(s, " "), of)).cast(kind)

    return F.aggregate(found, start, step, lambda acc: acc["found"])


def queries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = QUERIES) -> DataFrame:
    """(doc_id, pos, sentence, phrase): the first sentence of every phrase, and the first ``most`` of a document.

    The sentences of a row are chosen where its text is read; the windows are for rows that share an id. Behind them a phrase
    is cut from its sentence again, so that whoever reads phrases alone reads the same exchange as who reads sentences.
    """
    s = docs.select(doc_id, F.explode(first_of_phrases(sentences(F.col(text)), most)).alias("x")).select(doc_id, "x.pos", "x.sentence", "x.at", F.xxhash64("x.phrase").alias("h1"), F.xxhash64(F.lit("phrase"), "x.phrase").alias("h2"))
    s = s.withColumn("seen", F.row_number().over(W.partitionBy(doc_id, "h1", "h2").orderBy("pos"))).where("seen = 1").drop("seen", "h1", "h2")
    s = s.withColumn("nth", F.row_number().over(W.partitionBy(doc_id).orderBy("pos"))).where(F.col("nth") <= most)
    return s.select(doc_id, "pos", "sentence", phrase_at(F.split("sentence", " "), F.col("at")).alias("phrase"))


def risk(jaccard: Column, shares: Column) -> Column:
    return F.when(jaccard >= HIGH, "HIGH").when((jaccard >= GATE) | shares, "MEDIUM").otherwise("LOW")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(T.let(both, lambda n: n / (F.size(a) + F.size(b) - n)))


def holds(page: Column, part: Column) -> Column:
    """Whether normalised words in a row are among those of a normalised page, which has a space before and behind it."""
    return F.contains(page, F.concat(F.lit(" "), part, F.lit(" ")))


def sure(asked: Column) -> Column:
    """Whether a phrase is shared by its sentence and any page that holds it."""
    return F.size(T.rare_phrases(F.split(asked, " "), OVERLAP_STOPWORDS)) > 0


def keys(words: Column, n: Column) -> Column:
    """Hashes of all n words in a row."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def borne_out(sentence: Column, asked: Column, page: Column, shingles: Column) -> Column:
    """An array of the coefficient of a sentence and a page, and whether they share a phrase; empty if they are no match.

    Shingles are compared as hashes of 64 bits.
    """
    def of(w: Column) -> Column:
        coefficient = T.let(F.array_distinct(keys(w, F.lit(SHINGLE))), lambda mine: jaccard(mine, shingles))
        shares = F.when(sure(asked), True).otherwise(F.exists(T.rare_phrases(w, OVERLAP_STOPWORDS), lambda x: F.contains(page, x)))
        return F.struct(coefficient.alias("jaccard"), shares.alias("shares"))

    return F.filter(F.array(T.let(F.split(T.normalise(sentence), " "), of)), lambda x: (x["jaccard"] >= GATE) | x["shares"])


def first_pages(asked: DataFrame, pages: DataFrame, page_id: str) -> DataFrame:
    """(asked, page): of each phrase the first page that holds it, or all if holding it does not make a match."""
    w = F.split("asked", " ")
    asks = asked.select("asked").distinct().withColumn("n", F.least(F.size(w), F.lit(KEY_WORDS)))
    lengths = asks.agg(F.collect_set("n").alias("lengths"))  # keys of other lengths meet nothing
    of_page = T.let(F.split(F.trim("page"), " "), lambda words: F.array_distinct(F.flatten(F.transform("lengths", lambda n: keys(words, n)))))
    grams = pages.crossJoin(F.broadcast(lengths)).select(page_id, F.explode(of_page).alias("key"))
    met = asks.select("asked", "n", F.xxhash64(F.slice(w, F.lit(1), F.col("n"))).alias("key")).join(grams, "key").join(pages, page_id)
    # A phrase of a shingle's length is on no page without shingles. As this reads what the coefficient reads, pages are dealt out once.
    met = met.where(((F.size("shingles") > 0) | (F.col("n") < SHINGLE)) & holds(F.col("page"), F.col("asked")))
    return met.groupBy("asked", F.when(~sure(F.col("asked")), F.col(page_id)).alias("each")).agg(F.min(page_id).alias(page_id)).drop("each")


def check(docs: DataFrame, pages: DataFrame, doc_id: str = "doc_id", page_id: str = "page_id") -> DataFrame:
    """The first page (by id) that bears out a sentence: coefficient at GATE or more, or a shared phrase."""
    q = queries(docs, doc_id).withColumn("asked", T.normalise(F.col("phrase"))).where("asked <> ''")
    p = pages.select(F.col(page_id), "url", title(F.col("html")).alias("title"), F.concat(F.lit(" "), T.normalise(page_text(F.col("html"))), F.lit(" ")).alias("page"))
    p = p.withColumn("shingles", T.let(F.split(F.trim("page"), " "), lambda words: F.array_distinct(keys(words, F.lit(SHINGLE)))))
    met = q.join(first_pages(q, p.select(page_id, "page", "shingles"), page_id), "asked").join(p, page_id).where(holds(F.col("page"), F.col("asked")))
    met = met.withColumn("found", F.explode(borne_out(F.col("sentence"), F.col("asked"), F.col("page"), F.col("shingles")))).select("*", "found.jaccard", "found.shares")
    met = met.withColumn("place", F.row_number().over(W.partitionBy(doc_id, "pos", "asked").orderBy(page_id))).where("place = 1")
    phrases = F.filter(T.rare_phrases(F.split(T.normalise(F.col("sentence")), " "), OVERLAP_STOPWORDS), lambda x: F.contains("page", x))
    return met.select(doc_id, "pos", "sentence", page_id, "url", "title", "phrase", "jaccard", phrases.alias("phrases"), risk(F.col("jaccard"), F.col("shares")).alias("risk"))
