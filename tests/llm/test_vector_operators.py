"""Vector search against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.neighbours import Neighbours, nearest
from rankloom.llm.top_k import TopK, candidates, inner_products, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, VEC int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 24))
    rows = [(i, (centres[i % 8] + 0.7 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(120)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 22), (2002, [float("nan")] * 24), (2003, [0.0] * 24), (2004, [1.0, 2.0]), (2005, [2.0, 1.0]), (None, rows[1][1])]
    return [*rows, rows[5]]


def usable(vectors, nonzero):
    good = {i: v for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (not nonzero or any(v))}
    return {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in good.items()}


def test_top_k_equals_brute_force(spark, vectors):
    good = {i: np.floor(64 * v) for i, v in usable(vectors, False).items()}
    found = {}
    for r in top_k(table(spark, vectors), F.col("vec_id") % 20 == 0, how=TopK(rows=200, queries=16, wave=32)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (i for i in good if i % 20 == 0):
        rest = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and v.size == good[q].size)[:20]
        assert sorted(found.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(rest)]
    assert top_k(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def test_nearest_recall_and_scores(spark, vectors):
    good = usable(vectors, True)
    found = {}
    for r in nearest(table(spark, vectors), F.col("vec_id") % 10 == 0, Neighbours(lists=16, probes=11, rows=200, queries=16)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = whole = 0
    for q, got in found.items():
        near = sorted((np.sqrt(((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q and v.size == good[q].size)[:10]
        hits += len({i for _, i in near} & {i for _, i, _ in got})
        whole += len(near)
        assert q not in {i for _, i, _ in got} and [s for _, _, s in sorted(got)] == sorted(s for _, _, s in got)
        assert all(s == pytest.approx(np.sqrt(((good[q] - good[i]) ** 2).sum()), rel=1e-12) for _, i, s in got)
    assert hits >= 0.9 * whole and 2003 not in {i for g in found.values() for _, i, _ in g}
    assert nearest(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("size", [1e3, 1e6, 1e8, 1e12, 1e16, 1e200])
def test_inner_products_are_whole_numbers(size):
    rng = np.random.default_rng(int(np.log10(size)))
    q, x = (np.floor(rng.standard_normal((7, 33)) * size) for _ in range(2))
    exact = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]
    assert inner_products(q, x).tolist() == exact


@pytest.mark.parametrize("size", [1e6, 1e8, 1e200])
def test_top_k_of_very_large_components(spark, size):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.standard_normal(8) * (size if i % 3 else 1.0)).tolist()) for i in range(300)]
    good = {i: [int(np.floor(64 * x)) if abs(64 * x) < 2**53 else int(64 * x) for x in v] for i, v in vectors}
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = top_k(frame, F.col("vec_id") % 20 == 0, how=TopK(rows=100, queries=8, wave=32, sample=40)).collect()
    most = 10**38 - 1
    for q in range(0, 300, 20):
        rest = sorted((-max(-most, min(most, sum(a * b for a, b in zip(good[q], v, strict=True)))), i) for i, v in good.items() if i != q)[:20]
        wanted = [(n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(rest)]
        assert sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q) == wanted


def test_bounds_save_work_where_vectors_lie_in_clusters(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((10, 16)) * 6
    vectors = [(i, (centres[i % 10] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    made = candidates(frame, F.col("vec_id") % 20 == 0, how=TopK(queries=4, wave=64)).agg(F.sum("evaluated")).first()[0]
    assert 0 < made < 0.7 * 100 * 2000
