"""The checks that need no state, over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators import ailang, overlap

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def each_batch(stream: DataFrame, sources: DataFrame, out: str) -> DataStreamWriter:
    """Overlap and style results of every batch, appended to parquet; a batch that runs again replaces its own files."""

    def run(batch: DataFrame, number: int) -> None:
        found = overlap.matches(batch, sources)
        overlap.summary(batch, found).write.mode("overwrite").parquet(f"{out}/overlap/batch={number}")
        ailang.documents(ailang.analysed(batch)).drop("notes").write.mode("overwrite").parquet(f"{out}/style/batch={number}")

    return stream.writeStream.foreachBatch(run)
