"""Exact top-k search by inner product of quantised vectors, on a bit-sliced index.

A block of rows is indexed once: every attribute (component, moved to start at 0) as one bitmap a bit. A query multiplies
attributes by its own integers and adds them up by bitmap arithmetic alone: a set bit j of the multiplier puts slice i
among the bitmaps of weight i + j, those of a negative multiplier in complement, and carry-save adders turn three bitmaps
of a weight into one of it and one of the next. The slices of the sum are then read from the most significant downward:
rows above the cut are taken, rows below dropped, until k are left or the slices end; rows tied at the boundary are
resolved exactly, by id. The query's own id is masked out.

Every query block meets every row block once, each pair in a task of its own size; only k rows a query leave a block.

Vectors whose sums could pass 64 bits (components of 2^24 and more, divided by the root of their number) are wide: they lie
in blocks of their own, and their integers are Python's, which know no greatest number; the index is the same, with more
slices. Scores beyond 64 bits are compared exactly, and reported as the nearest number that a long holds.

Defined results: ids that are null, and vectors that are null, empty, or hold null or non-finite components take no part.
Vectors meet only vectors of as many components. Repeated rows are candidates each; a repeated query id asks once. Extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import block, matrix, merged, queries_of, replicated, usable

#: Rows indexed together, and queries that a task runs on them; rows and queries of a block of wide vectors.
ROWS, QUERIES, WIDE = 8_192, 2_048, 256
#: Vectors with a component of this and more, divided by the root of the number of components, are wide.
LIMIT = 2.0**24
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long, beyond binary"


class BitSliced:
    """Rows sorted by id; ``slices[d, i]`` is the bitmap of bit i of attribute d, ``slices[dims + d, i]`` its complement."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.n, self.dims = self.x.shape
        self.low = self.x.min(0)
        moved = self.x - self.low
        self.bits = max(1, int(moved.max()).bit_length())
        words = -(-self.n // 64)
        planes = np.zeros((self.dims, self.bits, words * 64), np.uint8)
        for i in range(self.bits):
            planes[:, i, : self.n] = ((moved >> i) & 1).astype(np.uint8).T
        packed = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)
        self.slices = np.concatenate([packed, ~packed]).reshape(2 * self.dims * self.bits, words)
        every = np.zeros(words * 64, np.uint8)
        every[: self.n] = 1
        self.rows = np.packbits(every, bitorder="little").view(np.uint64)

    def sum_slices(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of sum |q| * (attribute, or its complement where q is negative)."""
        size = np.abs(q)
        top = int(size.max()).bit_length()
        at_weight: list[list[np.ndarray]] = [[] for _ in range(top + self.bits - 1)]
        base = (np.arange(self.dims) + np.where(q < 0, self.dims, 0)) * self.bits
        for j in range(top):
            chosen = base[((size >> j) & 1).astype(bool)]
            for i in range(self.bits if len(chosen) else 0):
                at_weight[i + j].append(self.slices[chosen + i])
        out, w = [], 0
        while w < len(at_weight):
            maps = np.concatenate(at_weight[w]) if at_weight[w] else np.zeros((1, len(self.rows)), np.uint64)
            carries = []
            while len(maps) > 1:
                k = len(maps) // 3
                if k:
                    a, b, c = maps[:k], maps[k : 2 * k], maps[2 * k : 3 * k]
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    maps = np.concatenate([half ^ c, maps[3 * k :]])
                else:
                    carries.append((maps[0] & maps[1])[None])
                    maps = (maps[0] ^ maps[1])[None]
            out.append(maps[0])
            if carries:
                if w + 1 == len(at_weight):
                    at_weight.append([])
                at_weight[w + 1] += carries
            w += 1
        return out

    def top(self, query_id: int, q: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k best rows (all, if fewer), boundary ties to the smaller id."""
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        tied = self.rows
        if hi > lo:
            own = np.zeros(len(self.rows) * 64, np.uint8)
            own[lo:hi] = 1
            tied = tied & ~np.packbits(own, bitorder="little").view(np.uint64)
        taken = np.zeros_like(tied)
        for s in reversed(self.sum_slices(q)):
            above = taken | (tied & s)
            n = int(np.bitwise_count(above).sum())
            if n > k:
                tied = tied & s
            else:
                taken, tied = above, tied & ~s
                if n == k:
                    return positions(taken)
        rest = k - int(np.bitwise_count(taken).sum())
        return np.concatenate([positions(taken), positions(tied)[:rest]])


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantised(x: np.ndarray, scale: float, wide: bool) -> np.ndarray:
    """Whole parts of scaled components; as Python's integers if ``wide`` (a product that overflows is taken as of integers)."""
    if not wide:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, object)
    with np.errstate(over="ignore"):
        scaled = x * scale
    for at, v in np.ndenumerate(scaled):
        out[at] = math.floor(v) if math.isfinite(v) else int(x[at]) * int(scale)
    return out


def beyond(score: int) -> bytes:
    """What orders scores that are reported as the same least or greatest long; the same for all other scores."""
    if LEAST <= score <= MOST:
        return b"\x80"
    size = score.bit_length() // 8 + 1
    body = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\xff" + body if score > 0 else b"\x00" + bytes(255 - c for c in body)


def _pairs(rows: DataFrame, asked: DataFrame, sizes: tuple[int, int], k: int, scale: float, wide: bool) -> DataFrame:
    """FOUND rows: the k best of ``rows`` in each block, for every one of ``asked``; ``sizes`` are their numbers."""
    rb, row_blocks = block(sizes[0], WIDE if wide else ROWS, 1)
    qb, query_blocks = block(sizes[1], WIDE if wide else QUERIES, 2)
    left = replicated(rows.withColumn("rb", rb), "qb", query_blocks)
    right = replicated(asked.withColumn("qb", qb), "rb", row_blocks)

    def meet(r: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if r.num_rows and q.num_rows:
            index = BitSliced(r["vec_id"].to_numpy(), quantised(matrix(r, "v"), scale, wide))
            for query_id, vector in zip(q["vec_id"].to_numpy(), quantised(matrix(q, "v"), scale, wide), strict=True):
                best = index.top(query_id, vector, k)
                scores = (index.x[best] @ vector).tolist() if len(best) else []
                out[0] += [query_id] * len(best)
                out[1] += index.ids[best].tolist()
                out[2] += [max(LEAST, min(MOST, s)) for s in scores]
                out[3] += map(beyond, scores) if wide else [b"\x80"] * len(best)
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score", "beyond"])

    keys = ("dim", "rb", "qb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of every query."""
    rows = usable(vectors, id_col, vec_col)
    is_wide = F.exists("v", lambda x: F.abs(x) * F.sqrt("dim") >= LIMIT)
    asked = queries_of(rows, every)
    n, n_wide = rows.agg(F.count("*"), F.count(F.when(is_wide, True))).first()
    m, m_wide = asked.agg(F.count("*"), F.count(F.when(is_wide, True))).first()
    found = _pairs(rows.where(~is_wide), asked.where(~is_wide), (n - n_wide, m - m_wide), k, scale, False)
    if n_wide and m:
        found = found.unionAll(_pairs(rows.where(is_wide), asked, (n_wide, m), k, scale, True))
    if m_wide and n > n_wide:
        found = found.unionAll(_pairs(rows.where(~is_wide), asked.where(is_wide), (n - n_wide, m_wide), k, scale, True))
    return merged(found, k, "beyond")
