"""The registered setting of the nearest-vector query against brute force on a whole given table."""

import os

import numpy as np
import pytest

from rankloom.llm.queries import op5_near_vectors

TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the given tables")
def test_recall_of_the_registered_setting(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()
    column = next(c for c in rows[0].__fields__ if isinstance(rows[0][c], list))
    usable = {r.vec_id: np.array(r[column], dtype=float) for r in rows if r[column] and None not in r[column]}
    usable = {i: v for i, v in usable.items() if np.isfinite(v).all() and v.any()}
    ids, vectors = np.array(list(usable)), np.array(list(usable.values()))
    found = {}
    for r in op5_near_vectors(spark, TABLES).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(found) == {i for i in usable if i % 100 == 0}
    hits = 0
    for query, got in found.items():
        away = np.sqrt(((vectors - usable[query]) ** 2).sum(axis=1))
        away[ids == query] = np.inf
        nearest = ids[np.lexsort((ids, away))[:10]]
        hits += len(set(nearest.tolist()) & set(got))
        assert len(got) == 10 and all(score == pytest.approx(away[ids == i][0], rel=1e-9) for i, score in got.items())
    assert hits >= 0.9 * 10 * len(found)
