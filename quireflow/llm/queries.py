"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, mixing, oracles, pii, secrets, simhash, suffixes, topk, toxicity
from .common import crc_mod, read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows whose remainder modulo 3 is 1 are held out of the fit."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.classes(read_table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without repeated strings of 400 bytes."""
    return suffixes.spans_removed(read_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the highest integer inner product, for every query."""
    return topk.search(read_table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; rows whose remainder modulo 4 is 2 are held out of the fit."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found, for every query."""
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of personal data, of every document."""
    return pii.find(read_table(spark, sf_dir, "documents")).drop("spans")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size and target of every document in the mix."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_pii, op3_bpe, op4_mixing, op5_simhash, op6_suffixes, op7_secrets, op8_topk, op9_language_id, op10_ann, personal_data_base, mixing_targets)
}
ORACLE_SQL: dict[str, str] = {"op6_suffixes": oracles.REPEATS, "op7_secrets": oracles.SECRETS, "op8_topk": oracles.TOP, "personal_data_base": oracles.PERSONAL_DATA, "mixing_targets": oracles.TARGETS}
