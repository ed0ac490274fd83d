"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of the residuals are trained on a bounded sample; every row is indexed, in the list of
its nearest centroid and with a code a subspace. A query probes the lists whose centroids have the largest inner product
with it. In a list it builds asymmetric distance tables (its own components times every codeword), adds up table entries
and the centroid's share for each row, and reranks by the exact inner product of the original vectors all rows that may be
among the best: an approximate score is off by about the length of what the code leaves over, times that of the query,
divided by the root of the dimension, and rows of a dense cluster, which codes cannot tell apart, are all reranked.

The number of lists grows with the root of the number of rows, until the sample is too small for more. How many of them a
query probes is measured: as many as hold the share RECALL of the sample's own nearest neighbours. So clustered vectors
cost few probes, and vectors without clusters, as they must, most lists.

Vectors of each number of components have an index of their own. Lists are cut into blocks of rows, so that a list with a
large share of all rows is worked on by many tasks; queries of a list likewise. The numbers of blocks follow from the
sample's shares, so no row is assigned twice. Only k rows a query leave a block.

Defined results: ids that are null, and vectors that are null, empty, zero, or hold null or non-finite components take no
part. Vectors meet only vectors of as many components. A table with no usable row gives no result. Repeated rows are
candidates each; a repeated query id asks once. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction
from .vectors import FOUND, matrix, merged, queries_of, replicated, usable

#: About SAMPLE rows at most train the index, at least FLOOR (or all) of each number of components; a list needs PER_LIST of
#: them. WORDS codewords in each of about dim / WIDTH subspaces.
SAMPLE, FLOOR, PER_LIST, WORDS, WIDTH = 20_000, 512, 32, 128, 4
#: Share of the neighbours of TUNING sampled vectors that the probed lists have to hold.
RECALL, TUNING = 0.975, 256
#: Standard errors of an approximate score that decide about reranking; rows and queries of a block.
MARGIN, ROWS, QUERIES = 1.0, 8_192, 2_048


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty centroid moves to the point that is worst off."""
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        d = (centres * centres).sum(1) - 2 * x @ centres.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
    return centres


@dataclass
class Index:
    """Coarse centroids, the subspaces' bounds, their codebooks, probes a query, and each list's share of rows and queries."""

    centres: np.ndarray
    cuts: list[tuple[int, int]]
    books: list[np.ndarray]
    n_probes: int = 1
    row_blocks: np.ndarray | None = None
    query_blocks: np.ndarray | None = None

    @classmethod
    def train(cls, x: np.ndarray, rows: int, queries: int, k: int) -> Index:
        """From a sample ``x`` of ``rows`` vectors, ``queries`` of which ask for ``k`` neighbours."""
        centres = kmeans(x, max(1, min(round(math.sqrt(rows)), len(x) // PER_LIST)))
        own = cls._nearest(x, centres)
        rest = x - centres[own]
        parts = max(1, x.shape[1] // WIDTH)
        edges = np.arange(parts + 1) * x.shape[1] // parts
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        index = cls(centres, cuts, [kmeans(rest[:, a:b], WORDS) for a, b in cuts])
        index.n_probes = index._probes_for(x, own, k)
        index.row_blocks = index._blocks(np.bincount(own, minlength=len(centres)) / len(x), rows, ROWS)
        asked = index.probes(x[:: max(1, len(x) // 2_000)])
        index.query_blocks = index._blocks(np.bincount(asked.ravel(), minlength=len(centres)) / len(asked), queries, QUERIES)
        return index

    def _probes_for(self, x: np.ndarray, own: np.ndarray, k: int) -> int:
        """Lists to probe so that RECALL of the true neighbours of some sampled vectors lie in them; of equal vectors one counts."""
        x, first = np.unique(x, axis=0, return_index=True)
        own = own[first]
        some = np.random.default_rng(5).permutation(len(x))[:TUNING]
        scores = x[some] @ x.T
        scores[np.arange(len(some)), some] = -np.inf
        k = min(k, len(x) - 1)
        near = np.argpartition(-scores, max(0, k - 1), axis=1)[:, :k]
        place = np.argsort(np.argsort(-(x[some] @ self.centres.T), axis=1, kind="stable"), axis=1)
        at = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        return int(at[math.ceil(RECALL * len(at)) - 1]) + 1 if len(at) else 1

    @staticmethod
    def _blocks(share: np.ndarray, n: int, size: int) -> np.ndarray:
        return np.maximum(1, np.ceil(share * n / size)).astype(np.int32)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centres)

    def codes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = x - self.centres[own]
        return np.stack([self._nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def probes(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : self.n_probes]

    def scan(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries with the coded rows of a list."""
        out = np.repeat((q @ self.centres[which])[:, None], len(codes), 1)
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, a:b] @ book.T)[:, codes[:, m]]
        return out

    def left_over(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Length of the difference between rows and what their codes stand for."""
        rest = x - self.centres[which]
        total = np.zeros(len(x))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        return np.sqrt(total)

    def best(self, q: np.ndarray, which: int, x: np.ndarray, codes: np.ndarray, own: np.ndarray, k: int):
        """For each query: rows of a list (by position) to be its k best, and their exact scores. ``own`` masks rows out."""
        error = MARGIN * np.linalg.norm(q, axis=1)[:, None] * (self.left_over(x, which, codes) / math.sqrt(x.shape[1]))[None, :]
        near = self.scan(q, which, codes)
        near[own] = -np.inf
        low = near - error
        least = np.partition(low, -k, axis=1)[:, -k] if k < low.shape[1] else np.full(len(q), -np.inf)
        for i, may in enumerate((near + error >= least[:, None]) & ~own):
            row = np.flatnonzero(may)
            exact = (x[row] * q[i]).sum(1)  # row by row in one order, so that equal vectors tie
            top = np.argsort(-exact, kind="stable")[:k]
            yield row[top], exact[top]


def trained(rows: DataFrame, every: int, k: int) -> dict[int, Index]:
    """An index for each number of components of (vec_id, v, dim); a table has few different ones."""
    dims = {r["dim"]: (r["n"], r["m"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, True)).alias("m")).collect()}
    total = sum(n for n, _ in dims.values())
    part = F.lit(0.0)
    for dim, (n, _) in sorted(dims.items()):
        part = F.when(F.col("dim") == dim, min(1.0, max(SAMPLE / total, FLOOR / n))).otherwise(part)
    sample = rows.where(hash_fraction(F.col("vec_id"), F.lit(5)) < part).orderBy("vec_id", "v").toArrow() if dims else None
    out = {}
    for dim, (n, m) in dims.items():
        own = sample.filter(pc.equal(sample["dim"], dim))
        if not own.num_rows:
            own = rows.where(F.col("dim") == dim).limit(1).toArrow()
        out[dim] = Index.train(matrix(own, "v"), n, m, k)
    return out


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best found for every query, scored exactly."""
    rows = usable(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    indexes = rows.sparkSession.sparkContext.broadcast(trained(rows, every, k))  # centroids and codebooks, bounded by SAMPLE

    def by_dim(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            for dim in pc.unique(t["dim"]).to_pylist():
                own = t.filter(pc.equal(t["dim"], dim))
                yield indexes.value[dim], own, matrix(own, "v")

    def assign(batches):
        for index, own, x in by_dim(batches):
            at = index.lists(x)
            codes = [c.tobytes() for c in index.codes(x, at)]
            yield from own.append_column("list", pa.array(at, pa.int32())).append_column("codes", pa.array(codes, pa.binary())).append_column("rbs", pa.array(index.row_blocks[at])).append_column("qbs", pa.array(index.query_blocks[at])).to_batches()

    def probe(batches):
        for index, own, x in by_dim(batches):
            to = index.probes(x)
            copies = pa.array(np.repeat(np.arange(len(x)), to.shape[1]))
            at = to.ravel()
            for first in range(0, len(at), 10_000):
                part = at[first : first + 10_000]
                yield from own.take(copies[first : first + 10_000]).append_column("list", pa.array(part, pa.int32())).append_column("rbs", pa.array(index.row_blocks[part])).append_column("qbs", pa.array(index.query_blocks[part])).to_batches()

    names = "vec_id long, v array<double>, dim int, list int"
    indexed = rows.mapInArrow(assign, f"{names}, codes binary, rbs int, qbs int")
    asked = queries_of(rows, every).select("vec_id", "v", "dim").mapInArrow(probe, f"{names}, rbs int, qbs int")
    left = indexed.withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("rbs")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("qbs")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)))

    def meet(key, r: pa.Table, q: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if r.num_rows and q.num_rows:
            index = indexes.value[key[0].as_py()]
            order = np.argsort(r["vec_id"].to_numpy(), kind="stable")
            ids, x = r["vec_id"].to_numpy()[order], matrix(r, "v")[order]
            codes = np.frombuffer(b"".join(r["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            parts = []
            asking, vecs = q["vec_id"].to_numpy(), matrix(q, "v")
            for at in range(0, len(asking), 128):
                own = asking[at : at + 128, None] == ids[None, :]
                for query, (row, exact) in zip(asking[at : at + 128], index.best(vecs[at : at + 128], key[1].as_py(), x, codes, own, k), strict=True):
                    parts.append((np.full(len(row), query), ids[row], exact))
            out = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    keys = ("dim", "list", "rb", "qb")
    found = left.drop("rbs", "qbs").groupBy(*keys).cogroup(right.drop("rbs", "qbs").groupBy(*keys)).applyInArrow(meet, FOUND.format("double"))
    return merged(found, k)
