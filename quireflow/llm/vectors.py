"""Vectors for the two searches: which rows take part, blocks of rows against blocks of queries, and the merged top k.

Defined results: rows with a null id, and with a vector that is null, empty, or holds null or non-finite components, take no
part. Repeated rows are rows each; a repeated query id asks once, with its least vector. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score {}"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, dim): rows whose id is not null and whose vector has components, all of them finite numbers."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine).withColumn("dim", F.size("v"))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``; an id that occurs more than once asks once, with its least vector."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def block(n: int, size: int, salt: int) -> tuple[Column, int]:
    """A block number by the hash of the id, for blocks of about ``size`` out of ``n`` rows; and how many there are."""
    blocks = max(1, -(-n // size))
    return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks)).cast("int"), blocks


def replicated(df: DataFrame, name: str, blocks: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """The vectors of a table, one a row."""
    values = table[column].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def merged(found: DataFrame, k: int, *first: str) -> DataFrame:
    """The k best of each query over all blocks by score (and the columns ``first``), ties to the smaller id.

    Each task first keeps its own k best.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("score"), *map(F.desc, first), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
