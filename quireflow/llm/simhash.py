"""SimHash near-duplicates: fingerprints of word shingles, links at a small Hamming distance, connected classes.

Links are found over distinct fingerprints, with deletion-variant signatures. A fingerprint of 64 bits is cut into two
segments of 32. Of two fingerprints that differ in at most 3 bits, one segment differs in at most 1 bit; so when every
segment is indexed with each of its bits in turn left out (one-wildcard variants), the two meet in a signature. Pairs that
meet are verified on all bits.

A signature that many fingerprints share is not paired out. Members of such a bucket are cut again by the same rule: the
other segment's halves of 16 bits, with each bit in turn left out, refine the key until it holds few members; see ``links``.

Defined results: null, empty and word-less texts have fingerprint zero and are linked like any other; fewer words than a
shingle takes give one shingle of all words; rows with the same fingerprint (repeated rows, too) form a class by
themselves. Null ids never name a class unless it has no other id. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, fresh, map_texts

WORD = re.compile(rb"[^ \t-\r]+")
SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Upper-case A-Z to lower case, nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles hashed at a time, which bounds the memory for a very long text.
BLOCK = 100_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; a bit is set if more than half of the shingles' hashes have it."""
    words = WORD.findall(text.encode("utf-8", "replace").translate(LOWER))
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    total, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    lasts = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    for at in range(0, n, BLOCK):
        h = np.array([hashed(data[s:e], SEED) for s, e in zip(starts[at : min(at + BLOCK, n)].tolist(), lasts[at : at + BLOCK].tolist())], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep=("doc_id",), name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns and the fingerprint of the whole text, as a signed 64-bit number."""
    return map_texts(docs, text_col, lambda: lambda texts: [[_signed(fingerprint(t, shingle)) for t in texts]], [(name, "bigint")], list(keep))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# -- links -----------------------------------------------------------------------------------------------------------

#: Buckets with up to so many fingerprints are verified pair by pair within their row; larger ones are cut again. The
#: third cut leaves 11 free bits, so a bucket then holds 2,048 distinct fingerprints at most, whatever the input.
BUCKET = 64
#: Levels of the cut: first bit and width of the range whose two halves are indexed.
FIRST_WIDTH = 64


def _parts(low: str, half: int) -> str:
    """SQL for the bits of half ``floor(variant / half)`` of the range that starts at ``low``, without bit ``variant % half``."""
    return f"shiftrightunsigned(fp, {low} + cast(floor(variant / {half}) as int) * {half}) & {(1 << half) - 1}L & ~shiftleft(1L, cast(variant % {half} as int))"


def _mark(low: Column, half: int) -> Column:
    side, wild = F.floor(F.col("variant") / half).cast("int"), (F.col("variant") % half).cast("int")
    return F.struct(low.cast("int").alias("low"), F.lit(half).alias("half"), side.alias("side"), wild.alias("wild"))


def _first_signatures(distinct_fps: DataFrame) -> DataFrame:
    """Members (fp, key, marks, low, n) of all first-level buckets with two members or more.

    The one large shuffle of the search: 64 rows of two numbers a fingerprint, variant and bits packed into the key.
    """
    rows = distinct_fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("variant"))
    rows = rows.select("fp", F.expr(f"shiftleft(cast(variant as bigint), 32) | ({_parts('0', 32)})").alias("packed"))
    met = checkpoint(rows.withColumn("n", F.count("*").over(W.partitionBy("packed"))).where("n >= 2"))
    met = met.withColumn("variant", F.shiftright("packed", 32).cast("int"))
    return met.select("fp", F.array("packed").alias("key"), F.array(_mark(F.lit(0), 32)).alias("marks"), (32 - 32 * F.floor(F.col("variant") / 32)).cast("int").alias("low"), "n")


def _next_signatures(rows: DataFrame, width: int) -> DataFrame:
    """The same for the next cut of the bits low .. low + width - 1 of members of hot buckets; the key grows by it."""
    half = width // 2
    out = rows.select("fp", "key", "marks", F.col("low").alias("base"), F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("variant"))
    out = out.select(
        "fp", F.concat("key", F.array(F.col("variant").cast("bigint"), F.expr(_parts("base", half)))).alias("key"),
        F.concat("marks", F.array(_mark(F.col("base"), half))).alias("marks"), (F.col("base") + half - half * F.floor(F.col("variant") / half)).cast("int").alias("low"),
    )
    return checkpoint(out.withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n >= 2"))


def _canonical(marks: Column, x: Column, y: Column) -> Column:
    """Whether a pair is to be reported by this bucket: among the buckets in which it meets, exactly one says yes."""

    def one(m):
        def part(side):
            return F.call_function("shiftrightunsigned", x.bitwiseXOR(y), m["low"] + side * m["half"]).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), m["half"]) - 1)

        own_equal = part(m["side"]) == 0
        return (~own_equal | (m["wild"] == 0)) & ((m["side"] == 0) | (F.bit_count(part(F.lit(0))) >= 2))

    return F.forall(marks, one)


def _close(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= DISTANCE


def links(distinct_fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (column fp) at a distance of 1 to DISTANCE, each once.

    Members of a bucket of up to ``bucket`` are compared within one row, which gives only the links; members of larger
    buckets go on to the next cut.
    """
    out, width, rows = None, FIRST_WIDTH, _first_signatures(distinct_fps)
    for level in (1, 2, 3):
        last = level == 3
        small = rows if last else rows.where(F.col("n") <= bucket)
        lists = small.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("m"), F.first("marks").alias("marks"))
        pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y > x) & _close(x, y) & _canonical(F.col("marks"), x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        found = lists.select(F.inline(pairs))
        out = found if out is None else out.unionAll(found)
        hot = rows.where(F.col("n") > bucket)
        if last or hot.isEmpty():
            return out
        width //= 2
        rows = _next_signatures(hot, width)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b) but the roots; root is the least vertex reachable.

    Large-star and small-star rounds: each turns the edges towards smaller vertices, by one aggregate and one join on a
    vertex; the joins are plain, so that a vertex with very many edges can be split at run time.
    """
    at = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        both = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        at = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = at.groupBy("u").agg(F.min("v").alias("m"))
        near = at.join(least, "u")
        at = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        at = checkpoint(at)
        now = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == state:
            return at.select("u", F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def _rooted(known: DataFrame) -> DataFrame:
    """fp, the root of its class, and component_id, of all distinct fingerprints of ``known`` (id, fp)."""
    per = checkpoint(known.groupBy("fp").agg(F.min("id").alias("least")))
    stars = components(links(per.select("fp")))
    rooted = per.join(stars, per["fp"] == stars["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return checkpoint(rooted.join(named, "root").select("fp", "root", "component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    known = checkpoint(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"], "fp", shingle))
    return known.join(_rooted(known), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of every class: the one with the least id, then the least digest of the text.

    Rows are told apart by id and text, so null and shared ids stand for as many classes as their texts form; a null id
    comes last. Of rows that agree in both, one at most stays.
    """
    key, nth = fresh(docs, "kept_key"), fresh(docs, "kept_nth")

    def keyed(id_: str, text: str) -> Column:
        return F.concat(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), F.coalesce(F.concat(F.lit("="), F.col(id_).cast("string")), F.lit("")))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), keyed(id_col, text_col).alias("key"))
    known = checkpoint(fingerprints(rows, "text", ["id", "key"], "fp"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "key"))
    kept = known.join(_rooted(known).select("fp", "root"), "fp").groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias(key))
    out = docs.withColumn(key, keyed(id_col, text_col)).join(kept, key, "left_semi")
    out = out.withColumn(nth, F.row_number().over(W.partitionBy(key).orderBy(F.col(text_col).isNull())))
    return out.where(F.col(nth) == 1).select(*docs.columns)
