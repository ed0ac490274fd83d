"""A training corpus from raw documents: language ID, near-dedup, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Defined results: documents whose text is null, empty or without a letter go in the first stage, whatever their other
columns hold; a null id or source is a value like any other. Of equal rows, and of rows whose texts form a class, the second
stage keeps one. Ties are settled by the operators' rules, so reruns agree. An empty table gives an empty result. Extra
columns go through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quireflow.llm import bpe, langid, mixing, pii, simhash
from quireflow.llm.common import checkpoint, fresh, read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents of undetermined language (no letter, or no text) go."""
    pred, score = fresh(docs, "pred"), fresh(docs, "pred_score")
    model = langid.fit(docs)
    found = langid.predict(docs, model, keep=docs.columns, names=(pred, score)).where(f"{pred} <> '{langid.UNDETERMINED}'")
    return found.select(*[found[pred].alias(c) if c == "lang" else found[c] for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document with the least id stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents left out or repeated so that sources come near their target numbers of words."""
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text that they decode to."""
    return bpe.encode_decode(docs, TOKENIZER, keep=("doc_id", "lang", "source"), columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix_sources", mix_sources), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs


#: Hash functions and trained models have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None
