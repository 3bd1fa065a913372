"""Approximate nearest neighbours: inverted lists, scanned by blocks of rotated dimensions with early abandoning.

After a random rotation every block of dimensions is a random sample of a vector's energy, so the distance over the first d of
D dimensions, scaled by D/d, estimates the whole. A candidate is abandoned as soon as a test on that estimate rejects that it is
nearer than the k-th best so far; the others go on to the next block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import vectors as vs
from rankloom.llm.tables import store
from rankloom.llm.top_k import best_ranks


@dataclass(frozen=True)
class Neighbours:
    """``lists`` inverted lists are fitted on ``sample`` vectors at most (smallest digests of ids); a query probes ``probes``.
    ``columns`` dimensions are added between tests, ``strict`` is the width of the test in standard errors. Blocks hold
    about ``rows`` candidates and ``queries`` queries."""

    k: int = 10
    lists: int = 64
    probes: int = 44
    sample: int = 8192
    rounds: int = 8
    columns: int = 16
    strict: float = 3.0
    rows: int = 4096
    queries: int = 512


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every run."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)


def fit_lists(sample: np.ndarray, how: Neighbours) -> np.ndarray:
    """Centres by k-means; an empty list keeps its centre."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(5).permutation(len(centres))[: how.lists]]
    for _ in range(how.rounds):
        near = _squares(sample, centres).argmin(1)
        for i in np.unique(near):
            centres[i] = sample[near == i].mean(0)
    return centres


def scan_list(q: np.ndarray, x: np.ndarray, own: np.ndarray, how: Neighbours) -> np.ndarray:
    """Places of the candidates that pass all tests for one rotated query; ``own`` marks the query's own rows."""
    dim, alive = x.shape[1], np.flatnonzero(~own)
    first = alive[: 4 * how.k]
    near = np.sort(((x[first] - q) ** 2).sum(1))
    limit = near[how.k - 1] if near.size >= how.k else np.inf
    part = np.zeros(alive.size)
    for start in range(0, dim, how.columns):
        stop = min(start + how.columns, dim)
        part += ((x[alive, start:stop] - q[start:stop]) ** 2).sum(1)
        if stop < dim:
            keep = part * (dim / stop) <= limit * (1 + how.strict / np.sqrt(stop)) ** 2
        else:
            keep = part <= limit * (1 + 1e-9)
        alive, part = alive[keep], part[keep]
        if alive.size > how.k and stop < dim:
            # The most promising ones are finished now, which tightens the limit for the rest.
            best = alive[np.argpartition(part, how.k - 1)[: how.k]]
            limit = min(limit, ((x[best] - q) ** 2).sum(1).max())
    return alive


def nearest(embeddings: DataFrame, is_query: Column, how: Neighbours = Neighbours()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by Euclidean distance, nearest first, ties to smaller ids.

    Queries are the rows where ``is_query`` (on vec_id) holds, candidates all others than the query itself; null, zero and
    non-finite vectors take no part (``vectors.usable``). The lists are fitted on a bounded sample, every vector is in a list,
    and a long list is cut into blocks. Scores are computed on the original vectors. Where fewer than ``k`` candidates lie in
    the probed lists fewer rows come back, unless all lists are probed; an empty table gives no rows.
    """
    whole = store(vs.usable(embeddings, nonzero=True))
    counts = {r.dim: r["count"] for r in whole.groupBy("dim").count().collect()}
    found = None
    for dim in sorted(counts):
        part = _nearest_of_length(whole.filter(F.col("dim") == dim), dim, is_query, how)
        found = part if found is None else found.union(part)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best_ranks(found, how.k, ["score", "vec_id"]).select("query_id", "rank", "vec_id", "score")


def _nearest_of_length(rows: DataFrame, dim: int, is_query: Column, how: Neighbours) -> DataFrame:
    turn = rotation(dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample).select("vec").toArrow().column("vec").combine_chunks()
    centres = fit_lists(vs.matrix(sample) @ turn, how)

    def assign(count: int):
        def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                squares = _squares(vs.matrix(batch.column("vec")) @ turn, centres)
                near = np.argsort(squares, axis=1, kind="stable")[:, :count].astype(np.int32)
                places = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                taken = batch.select(["vec_id", "vec"]).take(places)
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near.ravel())], names=["vec_id", "vec", "list"])

        return per_batch

    schema = "vec_id long, vec array<double>, list int"
    filed = store(rows.mapInArrow(assign(1), schema))
    asked = store(rows.filter(is_query).mapInArrow(assign(min(how.probes, len(centres))), schema))

    def blocks(table: DataFrame, size: int) -> DataFrame:
        # One row per list: at most ``lists`` rows.
        lots = table.groupBy("list").agg(F.ceil(F.count("*") / F.lit(size)).alias("lots"))
        lot = F.pmod(F.xxhash64("vec_id"), F.col("lots"))
        return vs.packed(table.join(F.broadcast(lots), "list"), ["list"], lot)

    pairs = blocks(asked, how.queries).select("list", F.col("ids").alias("q_ids"), F.col("data").alias("q"))
    pairs = pairs.join(blocks(filed, how.rows), "list").select("q_ids", "q", "ids", "data")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, ids, data in zip(*batch.columns, strict=True):
                (q_ids, q), (ids, x) = vs.unpack(q_ids, q), vs.unpack(ids, data)
                turned_q, turned_x = q @ turn, x @ turn
                out = []
                for i in range(q_ids.size):
                    places = scan_list(turned_q[i], turned_x, ids == q_ids[i], how)
                    score = np.sqrt(((x[places] - q[i]) ** 2).sum(1))
                    best = np.lexsort((ids[places], score))[: how.k]
                    out.append((np.full(best.size, q_ids[i]), ids[places][best], score[best]))
                columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(per_batch, "query_id long, vec_id long, score double")
