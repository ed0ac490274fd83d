"""Searches and mixing against brute force, the pipeline as a whole, and the registered queries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quireflow.llm import ann, mixing, topk

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
VECTORS = "vec_id long, embedding array<double>, score int, dim int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], VECTORS)


def made(n=700, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[50:90] = x[40]  # ties
    return [(i, x[i].tolist()) for i in range(n)], x


def brute(ids, x, query, k=20):
    order = np.argsort(ids, kind="stable")
    s = x[order] @ query[1]
    s = np.where(ids[order] == query[0], -np.inf, s.astype(float))
    best = np.argsort(-s, kind="stable")[:k]
    return [int(i) for i in ids[order][best]]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("rows, queries", [(16_384, 512), (64, 7)])
def test_top_k_is_exact(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", queries)
    vectors, x = made()
    whole, got = np.floor(64 * x).astype(np.int64), found(topk.search(table(spark, vectors)))
    ids = np.arange(len(x))
    assert set(got) == set(range(0, len(x), 20))
    for q, hits in got.items():
        assert [i for i, _ in hits] == brute(ids, whole, (q, whole[q]))
        assert all(s == int(whole[i] @ whole[q]) for i, s in hits)


def test_neighbours_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 200)
    vectors, x = made(3000, 16)
    got, ids = found(ann.search(table(spark, vectors))), np.arange(len(x))
    hit = [len({i for i, _ in hits} & set(brute(ids, x, (q, x[q])))) for q, hits in got.items()]
    assert len(got) == 150 and sum(hit) / (20 * len(got)) >= 0.9
    assert all(abs(s - x[i] @ x[q]) < 1e-9 for q, hits in got.items() for i, s in hits)


def test_any_finite_component_takes_part(spark):
    """Components from fractions up to the greatest double, whose scores no long holds, next to small ones."""
    rng = np.random.default_rng(2)
    big = [0.5, -3.25, 1e7, -3e7, 2.0**40, -(2.0**62), 1e19, 1.7e308, -1.7e308]
    rows = [(i, [float(rng.choice(big if i % 3 else big[:2])) for _ in range(3)]) for i in range(130)] + [(1000, [1.0, 2.0]), (1001, [3e7, 0.0]), (1002, [1.0, 1.0]), (1020, [0.0, 1.0])]
    whole = {i: [int(np.floor(x * 64)) if abs(x) < 1e300 else int(x) * 64 for x in v] for i, v in rows}
    got = found(topk.search(table(spark, rows)))
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q, hits in got.items():
        scores = {i: sum(a * b for a, b in zip(v, whole[q])) for i, v in whole.items() if i != q and len(v) == len(whole[q])}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert hits == [(i, max(-(2**63), min(2**63 - 1, scores[i]))) for i in best]


def test_neighbours_among_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 2)), rng.normal(size=(50, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, v.tolist()) for i, v in enumerate(y)]
    got = found(ann.search(table(spark, rows)))
    assert set(got) == {0, 20, 40, 100, 120, 140}
    for q, hits in got.items():
        ids, own = (np.arange(60), x) if q < 100 else (np.arange(100, 150), y)
        assert [i for i, _ in hits] == brute(ids, own, (q, own[q % 100]))


def test_clashing_names_do_not_matter(spark):
    vectors, _ = made(60, 4)
    plain = table(spark, vectors)
    clashing = plain.selectExpr("vec_id", "embedding", "'a' as list", "1 as codes", "2 as rb", "3 as qb", "4 as v", "5 as rank", "6 as query_id", "7 as beyond")
    for search in (topk.search, ann.search):
        assert found(search(clashing)) == found(search(plain))


def test_probes_follow_the_clusters():
    rng = np.random.default_rng(6)
    centres = 8 * rng.normal(size=(40, 12))
    clustered = np.concatenate([c + 0.1 * rng.normal(size=(50, 12)) for c in centres])
    loose = rng.normal(size=(2000, 12))
    few, many = (ann.Index.train(x, len(x), 100, 20) for x in (clustered, loose))
    assert len(few.centres) == len(many.centres) == 45 and few.n_probes <= 12 < many.n_probes
    assert len(ann.Index.train(loose, 10_000, 500, 20).centres) == 2000 // 32 and ann.Index.train(loose, 1_000_000, 50_000, 20).row_blocks.sum() >= 1_000_000 / ann.ROWS


AWKWARD = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (1, [0.5, 0.5])]


def test_awkward_vectors(spark):
    got = found(topk.search(table(spark, AWKWARD)))
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {0: [1, 1, 20], 20: [0, 1, 1]}
    assert {q: [i for i, _ in hits] for q, hits in found(ann.search(table(spark, AWKWARD))).items()} == {0: [1, 1]}
    for search in (topk.search, ann.search):
        assert search(table(spark, [])).count() == 0
        assert search(table(spark, [(0, [1.0])])).count() == 0


def targets_brute(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, limit, free = {n: weights[i % 3] for i, n in enumerate(names)}, {n: 2 * sizes[n] for n in names}, 1.5 * sum(sizes.values())
    target, left = {n: 0.0 for n in names}, set(names)
    while left and free > 1e-9:
        share = {n: free * weight[n] / sum(weight[m] for m in left) for n in left}
        free = 0.0
        for n in list(left):
            target[n] += share[n]
            if target[n] >= limit[n]:
                free, target[n] = free + target[n] - limit[n], float(limit[n])
                left.remove(n)
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 400))), [None, "a", "b", "c", "d", "hot", "hot", "hot"][int(rng.integers(0, 8))], 9) for i in range(900)]
    return spark.createDataFrame([*rows, (1000, None, "none", 9), (1001, "", "none", 9)], "doc_id long, text string, source string, size int")


def test_mix_meets_its_targets(corpus):
    rows = mixing.mix(corpus).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets_brute(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
    assert all(abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]) for s in want)
    assert sorted(map(tuple, mixing.mix(corpus.repartition(7)).select("doc_id", "taken").collect())) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_resampled_rows(corpus, awkward, empty):
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(corpus).collect()}
    out = mixing.resample(corpus)
    assert out.columns == corpus.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in mixed.items() if n}
    assert mixing.mix(awkward).count() == 10 and mixing.resample(awkward).columns == awkward.columns
    assert mixing.mix(empty).count() == mixing.resample(empty).count() == 0


def test_newton_finds_the_tilt(spark):
    aimed = spark.createDataFrame([("a", 1000, 1500.0), ("b", 1000, 1.0), ("c", 0, 0.0), ("d", 7, 14.0)], "source string, source_size long, target double")
    assert {r["source"]: round(r["rate"], 9) for r in mixing.tilts(aimed).collect()} == {"a": 1.5, "b": 0.001, "c": 0.0, "d": 2.0}


@here
@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if n.startswith("op")])
def test_registered_queries_cover_their_tables(spark, name):
    rows = entry.queries()[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{'embeddings' if name in ('op8_topk', 'op10_ann') else 'documents'}.parquet").count()
    assert rows.count() == (n // 20 * 20 if name in ("op8_topk", "op10_ann") else n)


@here
def test_pipeline_against_its_own_decisions(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after, sizes = docs, []
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, after, SF)
        assert after.columns == docs.columns
        sizes.append(after.count())
    assert sizes[0] == docs.where(F.col("text").rlike(r"\p{L}")).count() and sizes[1] <= sizes[0] and sizes[2] == sizes[1]
    assert after.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9]")).count() == 0
    assert P.run(spark, SF).count() == sizes[3]


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty):
    import corpus_pipeline as P

    for docs in (awkward, empty):
        after = docs
        for name, stage in P.STAGES[:-1]:
            after = stage(spark, after, SF)
            assert after.columns == docs.columns, name
            rows = after.collect()
            if docs is awkward and name == "near_dedup":
                assert all(r["text"] and r["lang"] for r in rows) and len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
                assert sum(r["doc_id"] == 5 for r in rows) == 1 and sum(r["doc_id"] is None for r in rows) == 1
        out = P.STAGES[-1][1](spark, after, SF).collect()
        assert len(out) == len(rows) and (docs is awkward) == bool(out)
