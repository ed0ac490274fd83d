"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage unless its docstring says otherwise:

* a null text is an empty text; a null id is an id like any other;
* repeated rows are separate documents and each gets its own result row;
* columns other than the named id/text columns are ignored, so their names cannot clash;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed to an operator's kernel in slices of at most this many rows and about this many characters.
SLICE_ROWS, SLICE_CHARS = 2_000, 8_000_000

ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
}


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that keep a slice within SLICE_ROWS and, but for a single longer text, SLICE_CHARS."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= SLICE_ROWS or chars + len(text) > SLICE_CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    text_col: str,
    make_kernel: Callable[[], Callable[[list[str]], list[Sequence]]],
    fields: Sequence[tuple[str, str]],
    keep: Sequence[str],
    null_text: str | None = "",
) -> DataFrame:
    """Run a kernel over whole texts, Arrow batch by Arrow batch, without a shuffle.

    ``make_kernel`` is called once a task; its kernel turns a list of texts into one sequence for each of ``fields``
    (name, Spark type). The ``keep`` columns pass through untouched. Nulls reach the kernel as ``null_text``.
    """
    at = keep.index(text_col) if text_col in keep else len(keep)  # a text that is kept travels once
    text_name = fresh(df.select(*keep) if keep else df.limit(0), "text_in")
    src = df.select(*[F.col(c) for c in keep], *[F.col(text_col).alias(text_name)][: at == len(keep)])
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    kinds = [ARROW[t] for _, t in fields]
    names = [*keep, *[n for n, _ in fields]]

    def of_batch(kernel, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            rows = batch.slice(first, SLICE_ROWS)
            texts = [null_text if t is None else t for t in rows.column(at).to_pylist()]
            for start, end in text_slices([t or "" for t in texts] if null_text is None else texts):
                part = rows.slice(start, end - start)
                outs = [pa.array(x, type=k) for x, k in zip(kernel(texts[start:end]), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *outs], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            yield from of_batch(kernel, batch)
            del batch  # before the next one is read

    return src.mapInArrow(run, schema)


def crc_mod(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def hash_fraction(*cols: Column) -> Column:
    """A fixed number in [0, 1) for each value of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names in ``spark.checkpoint.dir``.

    A folder of the driver's own would be out of the executors' reach; so where none is named, only a session that runs in
    one process gets one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="quireflow-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> DataFrame:
    """Let go of shuffle files that only the lineage cut before ``df`` used: Spark drops them when the driver collects."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
