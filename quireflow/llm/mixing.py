"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Sources have target numbers of words. Among all document rates, entropy balancing looks for those closest to 1 (by relative
entropy, each word counting the same) that meet every source's target. The minimum is an exponential tilt: the rate of a
document is exp(lambda) of its source, where the lambdas maximise the concave dual
``sum over sources of target * lambda - size * exp(lambda)``. Newton steps on it need, of all documents, only the words
of each source, so one distributed aggregate feeds every step and the steps run on the table of sources.

Rates are rounded into copies: within strata of a source, ordered by size, evenly spaced documents get the larger of the
two whole numbers around the rate. Sixteen spacings are tried, and a source takes the one that lands nearest to its target.

Defined results: null texts have size 0; a null source is a source like any other and the last in order; a source without
words has target 0 and takes nothing; no target exceeds ``cap`` times its source. Repeated rows are separate documents.
Ties in order are broken by id. Rows that agree in source, size and id are alike to the mix, so whichever of them is
taken, the result is the same. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: White space that ends a word.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: Documents of a stratum, on average; Newton steps; spacings tried; sources up to which their table is broadcast.
STRATUM, STEPS, SPACINGS, BROADCAST_SOURCES = 4_000, 60, 16, 10_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A target for each row (source, source_size) of a table of sources.

    Sources by code point, null last, weigh ``weights`` in turn and divide ``share`` of all words; a target stops at
    ``cap`` times the source's words and the excess is divided again by weight. The final division gives each source the
    lesser of its cap and weight * level: with sources ordered by cap per weight, the capped ones come first.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))  # one row a source
    level = W.orderBy("per_weight", "place")
    done, all_rows = level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    table = F.array(*[F.lit(float(w)) for w in weights])
    out = sources.withColumn("place", F.row_number().over(order) - 1)
    out = out.withColumn("weight", F.element_at(table, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * cap)
    out = out.withColumn("per_weight", F.col("limit") / F.col("weight"))
    out = out.withColumn("budget", F.sum("source_size").over(all_rows) * share)
    rest = F.col("budget") - F.coalesce(F.sum("limit").over(done), F.lit(0.0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(done), F.lit(0.0))
    out = out.withColumn("level", rest / open_weight)  # were this source and those after it all below their caps
    out = out.withColumn("first_open", F.min(F.when(F.col("level") <= F.col("per_weight"), F.struct("per_weight", "place", "level"))).over(all_rows))
    free = F.col("first_open").isNotNull() & ((F.col("per_weight") > F.col("first_open.per_weight")) | ((F.col("per_weight") == F.col("first_open.per_weight")) & (F.col("place") >= F.col("first_open.place"))))
    return out.select("source", "source_size", F.when(free, F.least("limit", F.col("weight") * F.col("first_open.level"))).otherwise(F.col("limit")).alias("target"))


def tilts(aimed: DataFrame, steps: int = STEPS) -> DataFrame:
    """Adds ``rate`` = exp(lambda), lambda by Newton steps on the dual of each source's constraint.

    Gradient target - size * exp(lambda), Hessian -size * exp(lambda); a step is limited to 1, which makes it converge from
    anywhere. Targets of 0 have no finite lambda; their rate is 0.
    """
    def step(lam: Column, _: Column) -> Column:
        model = F.col("source_size") * F.exp(lam)
        return lam + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - model) / model))

    newton = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return aimed.withColumn("rate", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.exp(newton)).otherwise(F.lit(0.0)))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, cap=2.0) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))
    sized = checkpoint(sized)  # small rows; the texts are read and counted once
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aimed = checkpoint(tilts(targets(per.select("source", "source_size"))).join(per.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    few = aimed.count() <= BROADCAST_SOURCES

    def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        """A join on the source; the table goes to every task if it is small, else hot sources are split at run time."""
        table = table.withColumnRenamed("source", "s")
        return rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    placed = with_source(sized, aimed)
    # strata: a source's documents dealt by the hash of the id, ranked by size within
    mixed = F.pmod(F.xxhash64(F.col("id").cast("string"), F.col("size")), F.greatest(F.lit(1), F.ceil(F.col("rows") / STRATUM)))
    placed = placed.withColumn("stratum", mixed)
    rank = F.row_number().over(W.partitionBy("source", "stratum").orderBy(F.desc("size"), F.xxhash64(F.col("id").cast("string")), "id")) - 1
    placed = placed.withColumn("rank", rank).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))

    def extra(offset: Column) -> Column:
        """1 for the documents, evenly spaced, that get another copy."""
        return F.floor((F.col("rank") + 1) * F.col("part") + offset) - F.floor(F.col("rank") * F.col("part") + offset)

    # the start of the spacing differs from stratum to stratum, so that their errors do not add up
    start = F.pmod(F.xxhash64("source", "stratum"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def offset(k: Column) -> Column:
        x = start + k.cast("double") / SPACINGS
        return x - F.floor(x)

    tried = placed.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * (F.col("whole") + extra(offset(F.lit(k))))).alias(f"t{k}") for k in range(SPACINGS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(SPACINGS)]))["k"]
    placed = with_source(placed, tried.select("source", best.alias("spacing")))
    copies = F.least((F.col("whole") + extra(offset(F.col("spacing")))).cast("bigint"), F.lit(int(cap)).cast("bigint"))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def resample(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **aims) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    names = {n: fresh(docs, n) for n in ("mix_id", "mix_source", "mix_size", "mix_nth", "mix_copies")}
    same = [names[n] for n in ("mix_id", "mix_source", "mix_size")]

    def keyed(df: DataFrame, size: Column, order: list[Column]) -> DataFrame:
        df = df.withColumns({same[0]: F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), same[1]: F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")), same[2]: size})
        return df.withColumn(names["mix_nth"], F.row_number().over(W.partitionBy(*same).orderBy(*order)))

    taken = keyed(mix(docs, id_col, text_col, source_col, **aims), F.col("size"), [F.col("copies")]).where("copies > 0").select(*same, names["mix_nth"], F.col("copies").alias(names["mix_copies"]))
    rows = keyed(docs, size_of(F.col(text_col)), [F.xxhash64(text_col)]).join(taken, [*same, names["mix_nth"]])
    nth = fresh(rows, "mix_copy")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), names["mix_copies"])).alias(nth)).select(*docs.columns)
