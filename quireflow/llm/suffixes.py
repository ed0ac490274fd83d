"""Exact removal of repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

Removed is every byte covered by a string of ``window`` bytes that also starts anywhere else. Beside that, passages are
reported: strings of ``passage`` words that also stand in another document. Both are windows of symbols (bytes, or words)
and go one way. Equal windows have equal anchors (see ``anchors``), so windows are compared anchor by anchor. The windows
of an anchor are cut into buckets by how far left of the anchor they start; all windows of a bucket hold a common core:

1. Stretches (the windows of one bucket at one place) are counted by core; a core that occurs once holds no repeated window.
   Of the others, equal stretches form a class, all of whose windows are repeated if it has two members.
2. For the cores of several classes, one copy of each different stretch is fetched. The core, which all have in common, becomes a single
   symbol, so that the stretch has less than two slacks of symbols and a window is slack + 1 symbols. The transform of all
   stretches of some cores is built, and intervals are extended backward, breadth first: level by level this yields common
   prefixes by increasing value, and it stops at slack + 1. Windows whose common prefix with another stretch was not found
   by then are the repeated ones. To keep slacks short, stretches are first cut into buckets of FINE windows with a longer
   core each; equal ones need no transform.
3. A core with more than HOT different stretches is not brought together: its stretches are cut into finer buckets, whose
   cores are longer, and go through the same steps; buckets of one window are told apart by their cores alone.
4. The windows found are merged into spans of each document.

No row is a group's only one to hold it all: classes of stretches are counted before the shuffle, and joins on a core or a
class are plain, so that a hot key can be split at run time. Whole texts are told apart by MD5. Stretches that are removed
unseen agree in two hashes of 64 bits over different bases, one of the core and one of the stretch; slacks are compared
symbol by symbol.

Defined results: a null or empty text, and one shorter than a window, loses nothing. Repeated rows repeat each other's
windows, and share each other's passages. A passage repeated within one document alone is none. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import BASES, Sums, mixed, runs, words_of
from .common import checkpoint, fresh, release

WINDOW, PASSAGE = 400, 51
#: Different stretches that a task brings together on average, and of one core at most; windows of a finer bucket.
TOGETHER, HOT, FINE = 512, 512, 16
#: Bytes of the texts that a task walks at a time, but for a longer text.
SLICE = 1 << 21
#: Rows whose spans a task holds at a time.
ROWS = 200
#: Rows that a task gathers before it hands them on.
FLUSH = 2_000
#: A place is one number: start, number of windows, distance of the first one to the anchor, bucket; their lowest bits.
START, COUNT, AWAY, FIELD = 31, 19, 7, (1 << 12) - 1
#: Bucket numbers: those of words come behind those of bytes, then that of the row that stands for a whole text.
WORDS, WHOLE_TEXT = 50, 100
WORD = re.compile(r"[^ \t-\r]+")


@dataclass(frozen=True)
class Unit:
    """How windows of one kind of symbol are cut up; ``first`` is the number of its first bucket."""

    words: bool
    window: int
    gram: int
    buckets: int
    first: int

    def bounds(self) -> list[tuple[int, int]]:
        """Least and greatest distance from a window's start to its anchor, for each bucket."""
        edges = np.arange(self.buckets + 1) * (self.window - self.gram + 1) // self.buckets
        return [(int(a), int(b) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def units_of(window: int, passage: int | None) -> dict[int, tuple[Unit, int, int]]:
    """(unit, least and greatest distance to the anchor) of every bucket number."""
    if not 4 <= window <= FIELD or passage and not 2 <= passage <= FIELD:
        raise ValueError(f"windows of 4 and passages of 2 symbols at least, of {FIELD} at most")
    units = [Unit(False, window, min(40, window // 4), 2, 0), *([Unit(True, passage, min(10, passage // 2), 1, WORDS)] if passage else [])]
    return {u.first + k: (u, near, far) for u in units for k, (near, far) in enumerate(u.bounds())}


def stretches(symbols: np.ndarray, offsets: np.ndarray, unit: Unit) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, core, content, place) of every stretch."""
    for lo, values, sums, place, first, last in runs(symbols, offsets, unit.window, unit.gram):
        other = Sums(values, BASES[1])
        anchor = mixed(sums.of(place, place + unit.gram))
        for k, (near, far) in enumerate(unit.bounds()):
            begin, end = np.maximum(first, place - far), np.minimum(last, place - near)
            own = np.flatnonzero(begin <= end)
            if not len(own):
                continue
            begin, n, at = begin[own], (end - begin + 1)[own], place[own]
            core = mixed(sums.of(at - near, at - far + unit.window) + mixed(anchor[own] + np.uint64(unit.first + k)))
            away = at - begin
            content = mixed(other.of(begin, begin + n - 1 + unit.window) + mixed((away << 16 | n).astype(np.uint64)) + core)
            doc = np.searchsorted(offsets, begin + lo, "right") - 1
            yield doc, core.view(np.int64), content.view(np.int64), (begin + lo - offsets[doc]) << START | n << COUNT | away << AWAY | unit.first + k


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, without a copy, and the offsets of the texts in them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def stretch_rows(texts: DataFrame, window: int, passage: int | None, wide: bool) -> DataFrame:
    """The core of every stretch of a table (th, text), and if ``wide`` also content, th and place.

    Every text is a row, too, as the only stretch of itself.
    """
    units = list(dict.fromkeys(u for u, _, _ in units_of(window, passage).values()))
    schema = "core long" + (", content long, th binary, place long" if wide else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def made(th: pa.Array, doc, core, content, place) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(core), *([pa.array(content), th.take(pa.array(doc)), pa.array(place)] if wide else [])], names=names)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = symbols_of(batch.column(1))
            ends = np.append(np.flatnonzero(np.diff(offsets[1:] // SLICE)) + 1, batch.num_rows)  # some texts at a time
            for first, end in zip([0, *ends[:-1]], ends, strict=True):
                th, at = batch.column(0).slice(first, end - first), offsets[first : end + 1] - offsets[first]
                own = data[offsets[first] : offsets[end]]
                halves = np.frombuffer(b"".join(th.to_pylist()), np.int64).reshape(-1, 2)
                yield made(th, np.arange(len(th)), halves[:, 0], halves[:, 1], np.full(len(th), 1 << COUNT | WHOLE_TEXT))
                for unit in units:
                    for part in stretches(*(words_of(own, at) if unit.words else (own, at)), unit):
                        yield made(th, *part)

    return texts.select("th", "text").mapInArrow(run, schema)


# -- the transform -----------------------------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a sequence, ordered by their first ``depth`` symbols or more, by doubling."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, k = len(symbols), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = steps
        k *= 2
        if k >= depth or steps[-1] == n - 1 or k >= n:
            return order


def repeated(symbols: np.ndarray, length: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``length`` symbols from each position on occur at another position of another owner, too.

    Never true near the end. Positions are taken round, so that every suffix has a symbol before it; separators differ, so
    no common prefix runs over the end of a stretch. Without owners, every position is its own.
    """
    n = len(symbols)
    order = suffix_order(symbols, 2 * length).astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    before = symbols[order - 1].astype(np.int32)  # the transform
    step = place[order - 1]  # where a row goes when it is extended by the symbol before
    known = np.zeros(n + 1, bool)  # boundaries between rows whose common prefix has been found
    known[0] = known[n] = True
    interval = np.zeros(n, np.int32)  # first row of the interval that a row is in, at this level
    label, source, reached = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n, bool)
    active = np.arange(n)
    for _ in range(length):
        to = step[active]
        label[to], source[to] = before[active], interval[active]
        reached[:] = False
        reached[to] = True
        rows = np.flatnonzero(reached)
        own, of = label[rows], source[rows]
        # a boundary where neighbours come from different intervals or by different symbols, or the neighbour is settled
        fresh_cut = np.ones(len(rows), bool)
        fresh_cut[1:] = (rows[1:] != rows[:-1] + 1) | (own[1:] != own[:-1]) | (of[1:] != of[:-1])
        going_on = ~(known[rows] & known[rows + 1])  # a row that was alone before adds nothing
        known[rows[fresh_cut]] = True
        known[rows[np.append(fresh_cut[1:], True)] + 1] = True
        interval[rows] = rows[np.maximum.accumulate(np.where(fresh_cut, np.arange(len(rows)), 0))]
        active = rows[going_on]
        if not len(active):
            break
    heads = np.flatnonzero(known[:n])
    of = (np.arange(n) if owner is None else owner)[order]
    several = np.minimum.reduceat(of, heads) != np.maximum.reduceat(of, heads)
    out = np.zeros(n, bool)
    out[order] = np.repeat(several, np.diff(np.append(heads, n)))
    return out


def ranges(flags: np.ndarray) -> list[dict]:
    """First and last index of every run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


RANGES = "array<struct<lo:int,hi:int>>"
#: A class of stretches: windows, symbols of a slack, bytes of a symbol, and the symbols left and right of the core.
CLASS = "core long, content long, n int, slack int, item int, left binary, right binary, owner long"


def cut_finer(left: bytes, right: bytes, n: int, slack: int, item: int, wide: int) -> Iterator[tuple[int, int, int, int, bytes, bytes, bytes, bytes]]:
    """The windows of a stretch in buckets of ``wide``: first and last window, least and greatest distance to the core's
    start, and the symbols left of, at the left end of, at the right end of and right of the longer core."""
    shift = len(left) // item
    for near in range(0, slack + 1, wide):
        far = min(near + wide - 1, slack)
        lo, hi = max(0, shift - far), min(n - 1, shift - near)
        if lo <= hi:
            at, to = (shift - near) * item, (slack - far) * item
            yield lo, hi, near, far, left[lo * item : at], left[at:], right[:to], right[to : (hi - shift + slack) * item]


def compare(table: pa.Table) -> pa.Table:
    """Ranges of repeated windows of each class of stretches (a class may come more than once, but counts once).

    The stretches are cut into buckets of FINE windows. Of those with one core, equal ones are found as such, and different
    ones by interval expansion.
    """
    rows = list({(r["core"], r["content"]): r for r in table.to_pylist()}.values())
    flags = [np.zeros(r["n"], bool) for r in rows]
    cores: dict[tuple, dict[tuple, list[tuple[int, int]]]] = {}
    for i, r in enumerate(rows):
        for lo, hi, near, far, l_own, l_core, r_core, r_own in cut_finer(r["left"], r["right"], r["n"], r["slack"], r["item"], FINE):
            kind = cores.setdefault((r["core"], r["item"], near, far, l_core, r_core), {})
            kind.setdefault((l_own, r_own, hi - lo + 1), []).append((i, lo))
    alike: dict[tuple[int, int], list] = {}
    for number, ((_, item, near, far, *_), kinds) in enumerate(cores.items()):
        for place, ((l_own, r_own, n), members) in enumerate(kinds.items()):
            owners = {rows[i]["owner"] for i, _ in members}
            if len(owners) > 1:
                for i, lo in members:
                    flags[i][lo : lo + n] = True
            if len(kinds) > 1:
                alike.setdefault((item, far - near), []).append((number, l_own, r_own, n, members, (number, place) if len(owners) > 1 else min(owners)))
    for (item, slack), classes in alike.items():
        kind = np.uint8 if item == 1 else np.uint64
        sides = [(np.frombuffer(c[1], kind), np.frombuffer(c[2], kind)) for c in classes]
        ranks = np.unique(np.concatenate([x for s in sides for x in s]), return_inverse=True)[1].ravel()
        first = int(ranks.max(initial=0)) + 1 + len(classes)
        core_symbols = {c: first + k for k, c in enumerate(dict.fromkeys(c[0] for c in classes))}
        owner_numbers = {o: k for k, o in enumerate(dict.fromkeys(c[5] for c in classes))}
        pieces, starts, at, done = [], [], 0, 0
        for j, (c, (left, right)) in enumerate(zip(classes, sides, strict=True)):
            own = ranks[done : done + len(left) + len(right)]
            done += len(own)
            pieces.append(np.concatenate([own[: len(left)], [core_symbols[c[0]]], own[len(left) :], [first - 1 - j]]))
            starts.append(at)
            at += len(pieces[-1])
        owner = np.repeat(np.array([owner_numbers[c[5]] for c in classes]), [len(p) for p in pieces])
        found = repeated(np.concatenate(pieces).astype(np.int64), slack + 1, owner)
        for start, (_, _, _, n, members, _) in zip(starts, classes, strict=True):
            for i, lo in members:
                flags[i][lo : lo + n] |= found[start : start + n]
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    return pa.table({"core": pa.array([r["core"] for r in rows], pa.int64()), "content": pa.array([r["content"] for r in rows], pa.int64()), "ranges": pa.array(map(ranges, flags), kind)})


def batch_of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def slacks(texts: DataFrame, wanted: DataFrame, window: int, passage: int | None) -> DataFrame:
    """CLASS rows for rows (core, content, whole, th, place), with the symbols cut out of the texts.

    Classes that are repeated as a whole are an owner of their own, and so are all stretches of bytes. Of copies of a text a
    task reads one, so a class comes as often as tasks share its text, once as a rule.
    """
    buckets = units_of(window, passage)
    wanted = wanted.where(bucket(F.col("place")) < WHOLE_TEXT)  # whole texts have no core
    per = wanted.groupBy("th").agg(F.collect_list(F.struct("core", "content", "whole", "place")).alias("wanted"))
    texts = texts.select("th", "text").join(per, "th")
    names = ["core", "content", "n", "slack", "item", "left", "right", "owner"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches):
        seen = set()
        for b in batches:
            out = []
            for th, text, items in zip(b.column("th").to_pylist(), b.column("text"), b.column("wanted"), strict=True):
                if th in seen:
                    continue
                seen.add(th)
                items = items.as_py()
                data = np.frombuffer(text.as_buffer(), np.uint8)
                words = words_of(data, np.array([0, len(data)]))[0] if any(buckets[x["place"] & 127][0].words for x in items) else None
                for x in items:
                    unit, near, far = buckets[x["place"] & 127]
                    start, n, away = x["place"] >> START, x["place"] >> COUNT & FIELD, x["place"] >> AWAY & FIELD
                    symbols, at = words if unit.words else data, start + away
                    left, right = symbols[start : at - near], symbols[at - far + unit.window : start + n - 1 + unit.window]
                    owner = x["core"] ^ x["content"] if x["whole"] or not unit.words else int.from_bytes(th[:8], "little", signed=True)
                    out.append((x["core"], x["content"], n, far - near, symbols.itemsize, left.tobytes(), right.tobytes(), owner))
                if len(out) >= FLUSH:
                    yield batch_of(out, kinds, names)
                    out = []
            if out:
                yield batch_of(out, kinds, names)

    return texts.mapInArrow(run, CLASS)


def finer(classes: DataFrame) -> DataFrame:
    """The stretches of CLASS rows cut into buckets of FINE windows, or of one where FINE were before.

    CLASS rows with longer cores, and of whose class they are (``of_core``, ``of_content``) from which window on (``skip``).
    """
    names = ["core", "content", "n", "slack", "item", "left", "right", "owner", "of_core", "of_content", "skip"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def digest(*parts: bytes) -> int:
        return int.from_bytes(blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                out = []
                for r in b.slice(at, ROWS).to_pylist():
                    core, slack = r["core"].to_bytes(8, "little", signed=True), r["slack"]
                    for lo, hi, near, far, l_own, l_core, r_core, r_own in cut_finer(r["left"], r["right"], r["n"], slack, r["item"], FINE if slack >= FINE else 1):
                        number = near.to_bytes(4, "little") + far.to_bytes(4, "little")
                        longer = digest(b"c", number, core, l_core, r_core)
                        content = digest(b"s", number, core, len(l_own).to_bytes(4, "little"), l_own, l_core, r_core, r_own)
                        out.append((longer, content, hi - lo + 1, far - near, r["item"], l_own, r_own, r["owner"], r["core"], r["content"], lo))
                yield batch_of(out, kinds, names)

    return classes.select(*names[:8]).mapInArrow(run, f"{CLASS}, of_core long, of_content long, skip int")


def found_in(classes: DataFrame, several: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(core, content, ranges): repeated windows of classes, whose cores have the number of classes that ``several`` says.

    ``fetch`` turns them into CLASS rows. Both tables are cut off from their lineage.
    """
    few = F.col("different") <= HOT
    total, hot = several.agg(F.coalesce(F.sum(F.when(few, F.col("different"))), F.lit(0)), F.count(F.when(~few, True))).first()
    of = classes.join(several, "core")
    rows = fetch(of.where(few).drop("different")).withColumn("together", F.pmod(F.xxhash64("core"), F.lit(max(1, -(-total // TOGETHER)))))
    found = rows.groupBy("together").applyInArrow(compare, f"core long, content long, ranges {RANGES}")
    if not hot:
        return found
    hot = fetch(of.where(~few).drop("different"))
    cut = release(checkpoint(finer(hot)))
    kinds = cut.groupBy("core", "content").agg(F.min("owner").alias("least"), F.max("owner").alias("most"), F.min(F.struct("n", "slack", "item", "left", "right")).alias("one"))
    whole = F.col("least") != F.col("most")
    kinds = checkpoint(kinds.select("core", "content", "one.*", whole.alias("whole"), F.when(whole, F.col("core").bitwiseXOR(F.col("content"))).otherwise(F.col("least")).alias("owner")))
    several = checkpoint(kinds.groupBy("core").agg(F.count("*").alias("different")).where("different > 1"))
    longer = found_in(kinds.drop("whole"), several, lambda rows: rows)
    longer = longer.unionAll(kinds.where("whole").select("core", "content", F.expr(f"cast(null as {RANGES})").alias("ranges")))
    back = cut.select("core", "content", "of_core", "of_content", "skip", "n").join(longer, ["core", "content"])
    every = F.array(F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi")))
    moved = F.transform(F.coalesce("ranges", every), lambda r: F.struct((r["lo"] + F.col("skip")).alias("lo"), (r["hi"] + F.col("skip")).alias("hi")))
    return found.unionAll(back.select(F.col("of_core").alias("core"), F.col("of_content").alias("content"), moved.alias("ranges")))


def bucket(place: Column) -> Column:
    return place.bitwiseAND((1 << AWAY) - 1).cast("int")


def repeated_windows(texts: DataFrame, window: int = WINDOW, passage: int | None = PASSAGE) -> DataFrame:
    """(th, bucket, lo, hi): starts of repeated windows, as ranges that may come again, of a table (th, text); th digests the text.

    Buckets from WORDS on are of words, and WHOLE_TEXT says that the text itself occurs more than once.
    """
    met = checkpoint(stretch_rows(texts, window, passage, wide=False).groupBy("core").agg(F.count("*").alias("times")).where("times > 1").select(F.col("core").alias("met_core")))
    rows = stretch_rows(texts, window, passage, wide=True)
    rows = release(checkpoint(rows.join(met, rows["core"] == met["met_core"]).drop("met_core")))
    classes = rows.groupBy("core", "content").agg(F.count("*").alias("copies"), F.min(F.struct("th", "place")).alias("one"), F.max("th").alias("most"))
    whole = F.when(bucket(F.col("one.place")).between(WORDS, WHOLE_TEXT - 1), F.col("one.th") != F.col("most")).otherwise(F.col("copies") > 1)
    classes = release(checkpoint(classes.select("core", "content", "one.*", whole.alias("whole"))))
    several = checkpoint(classes.groupBy("core").agg(F.count("*").alias("different")).where("different > 1"))
    found = release(checkpoint(found_in(classes, several, lambda wanted: slacks(texts, wanted, window, passage)).where("size(ranges) > 0")))
    found = found.unionAll(classes.where("whole").select("core", "content", F.expr(f"cast(null as {RANGES})").alias("ranges")))
    start, last = F.shiftright("place", START).cast("int"), F.shiftright("place", COUNT).bitwiseAND(FIELD).cast("int") - 1
    spans = rows.join(found, ["core", "content"]).select("th", bucket(F.col("place")).alias("bucket"), start.alias("start"), F.explode(F.coalesce("ranges", F.array(F.struct(F.lit(0).alias("lo"), last.alias("hi"))))).alias("s"))
    return spans.select("th", "bucket", (F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi"))


def covered(cuts: list[dict], window: int) -> list[tuple[int, int]]:
    """Maximal spans covered by windows whose starts come as ranges."""
    out: list[list[int]] = []
    for r in sorted(cuts, key=lambda r: r["lo"]):
        if out and r["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["hi"] + window)
        else:
            out.append([r["lo"], r["hi"] + window])
    return [(a, b) for a, b in out]


def spans_removed(docs: DataFrame, text_col: str = "text", keep=("doc_id",), window: int = WINDOW, passage: int | None = PASSAGE, texts_too: bool = False) -> DataFrame:
    """The ``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words (and ``kept``) of every row.

    A passage is a maximal run of words covered by strings of ``passage`` words that also stand in another document (none if
    ``passage`` is None); ``kept`` are the remaining bytes.
    """
    whole_text = F.coalesce(F.col(text_col), F.lit(""))
    th: Column = F.unhex(F.md5(whole_text.cast("binary")))
    texts = docs.select(th.alias("th"), whole_text.alias("text"))
    least = min([window, *([2 * passage - 1] if passage else [])])
    found = repeated_windows(texts.where(F.octet_length("text") >= least), window, passage)
    per = found.groupBy("th").agg(F.collect_set(F.struct("bucket", "lo", "hi")).alias("ranges"))
    own = docs.select(*keep)
    key, name, whole = fresh(own, "th"), fresh(own, "cut"), fresh(own, "whole")
    joined = docs.select(*keep, whole_text.alias(whole), th.alias(key)).join(per.select(F.col("th").alias(key), F.col("ranges").alias(name)), key, "left")
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("n_passage_words", pa.int64()), *([("kept", pa.binary())] if texts_too else [])]

    def passages(text: pa.Scalar, cuts: list[dict]) -> list[tuple[int, int]]:
        if passage and any(r["bucket"] == WHOLE_TEXT for r in cuts):
            n = sum(1 for _ in WORD.finditer(text.as_py()))
            return [(0, n)] if n >= passage else []
        return covered([r for r in cuts if WORDS <= r["bucket"] < WHOLE_TEXT], passage or 0)

    def one(text: pa.Scalar, cuts: list[dict]) -> tuple:
        data, at, digest, kept = memoryview(text.as_buffer()), 0, sha256(), []
        spans = covered([r for r in cuts if r["bucket"] < WORDS], window)
        for lo, hi in [*spans, (len(data), len(data))]:
            digest.update(data[at:lo])
            if texts_too:
                kept.append(data[at:lo])
            at = hi
        shared = passages(text, cuts)
        removed = sum(hi - lo for lo, hi in spans)
        return (len(data), removed, len(spans), digest.hexdigest(), len(shared), sum(b - a for a, b in shared), b"".join(kept))[: len(fields)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # some rows at a time, so that few ranges are Python's objects
                b = batch.slice(at, ROWS)
                out = [one(text, cuts or []) for text, cuts in zip(b.column(len(keep)), b.column(len(keep) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)]], names=[*keep, *[n for n, _ in fields]])

    src = joined.select(*keep, whole, name)
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long" + (", kept binary" if texts_too else "")
    return src.mapInArrow(run, T.StructType([*own.schema.fields, *T._parse_datatype_string(ddl).fields]))
