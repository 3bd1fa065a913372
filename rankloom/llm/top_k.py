"""Exact top-k search by pivot tables.

The distances of all vectors to pivots chosen far apart are stored with the vectors. By the triangle inequality they give the
largest lower bound of every query-to-candidate distance, and with it an upper bound of their inner product. A query starts with
the k-th score that a sample of candidates guarantees it; candidates are dealt into strips once, the queries are led past every
strip, and a strip's candidates are evaluated in the order of their bounds until no bound reaches any query's k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import vectors as vs
from rankloom.llm.tables import store

_EXACT = 2.0**53
_LIMB = 18
_MOST = 10**38 - 1


@dataclass(frozen=True)
class TopK:
    """``pivots`` reference vectors, each far from those before it, out of a ``sample`` of vectors (smallest digests of their
    ids); strips of about ``rows`` candidates, lots of ``queries`` queries; ``wave`` candidates are evaluated at once."""

    k: int = 20
    pivots: int = 16
    sample: int = 1024
    rows: int = 8192
    queries: int = 256
    wave: int = 1024


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as longs where no sum can pass 2**53, else as Python integers."""
    size = max(1, q.shape[1]) * float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0))
    if size < _EXACT:
        return (q @ x.T).astype(np.int64)
    if max(np.abs(q).max(), np.abs(x).max()) >= 2.0 ** (3 * _LIMB):
        whole = lambda v: np.array([[int(c) for c in row] for row in v], dtype=object)
        return whole(q) @ whole(x).T
    total = np.zeros((q.shape[0], x.shape[0]), dtype=object)
    for i, a in enumerate(_limbs(q)):
        for j, b in enumerate(_limbs(x)):
            total += (a @ b.T).astype(np.int64).astype(object) * (1 << _LIMB * (i + j))
    return total


def _limbs(v: np.ndarray) -> list[np.ndarray]:
    """Three numbers of 18 bits and a sign for each whole number below 2**54, the lowest first."""
    rest, out = v.astype(np.int64), []
    for _ in range(2):
        out.append((rest & ((1 << _LIMB) - 1)).astype(np.float64))
        rest = rest >> _LIMB
    return [*out, rest.astype(np.float64)]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, those of more than 38 digits as the largest number of 38 digits with their sign."""
    out = inner_products(q, x)
    return np.clip(out, -_MOST, _MOST) if out.dtype == object else out


def _lower(scores: np.ndarray) -> np.ndarray:
    """A little lower than the scores, whose last bits a double may have rounded."""
    return np.where(np.isfinite(scores), scores - np.abs(np.where(np.isfinite(scores), scores, 0.0)) * 1e-12, scores)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The row of the pivot table of every vector. Vectors too large for doubles get no finite distance and so no bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots], axis=1)


def _bounds(q: np.ndarray, x: np.ndarray, to_q: np.ndarray, to_x: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products: half of both squares less the square of the least possible distance."""
    apart = np.zeros((q.shape[0], x.shape[0]))
    one = np.empty_like(apart)
    with np.errstate(over="ignore", invalid="ignore"):
        for p in range(to_q.shape[1]):
            np.subtract(to_q[:, p, None], to_x[None, :, p], out=one)
            np.abs(one, out=one)
            np.fmax(apart, one, out=apart)
        squares = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
        np.multiply(apart, apart, out=apart)
        # The slack is far above the rounding of sums, squares and roots.
        bound = (squares - apart) / 2.0 + (0.5 + 1e-9 * squares)
    return np.where(np.isnan(bound), np.inf, bound)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest entries of every row, ties to smaller ids, both in that order; ids of -1 are places left empty."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k] if scores.dtype != object else np.array([sorted(range(s.size), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(scores, ids, strict=True)])
    rows = np.arange(scores.shape[0])[:, None]
    return scores[rows, order], ids[rows, order]


def guaranteed(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Per query a score that k of the candidates reach (-inf: there are fewer), as a double not above it."""
    scores = _scores(q, x).astype(np.float64)
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(q_ids.size, -np.inf)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def search_strip(
    q_ids: np.ndarray, q: np.ndarray, to_q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, to_x: np.ndarray, how: TopK
) -> tuple[list, int]:
    """(query_id, vec_id, score) of the k best candidates of a strip for each query, as far as they reach the query's ``least``
    score, and the number of pairs that were evaluated."""
    bounds = _bounds(q, x, to_q, to_x)
    bounds[q_ids[:, None] == ids[None, :]] = -np.inf
    stop = _lower(least)
    order = np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable")
    scores, found, evaluated = None, None, 0
    rest = np.maximum.accumulate(bounds[:, order][:, ::-1], axis=1)[:, ::-1] if order.size else bounds
    for at in range(0, order.size, how.wave):
        live = np.flatnonzero(rest[:, at] >= stop)
        if not live.size:
            break
        part = order[at : at + how.wave]
        got = _scores(q[live], x[part])
        evaluated += got.size
        names = np.broadcast_to(ids[part], got.shape).copy()
        hit = (got.astype(np.float64) >= stop[live, None]) & (q_ids[live, None] != names)
        wide = int(hit.sum(axis=1).max(initial=0))
        if not wide:
            continue
        # Only what reaches the stopping score is ranked: moved to the left of its row.
        left = np.argsort(~hit, axis=1, kind="stable")[:, :wide]
        rows = np.arange(live.size)[:, None]
        new = np.where(hit[rows, left], names[rows, left], np.iinfo(np.int64).max)
        low = -10 * _MOST if got.dtype == object else np.iinfo(np.int64).min + 1
        new_scores = np.where(hit[rows, left], got[rows, left], low)
        if scores is None:
            scores = np.full((q_ids.size, 0), low, dtype=new_scores.dtype)
            found = np.zeros((q_ids.size, 0), dtype=np.int64)
        if new_scores.dtype == object and scores.dtype != object:
            scores = scores.astype(object)
        both = np.concatenate([scores[live], new_scores.astype(scores.dtype)], axis=1), np.concatenate([found[live], new], axis=1)
        top, top_ids = _best(*both, how.k)
        if top.shape[1] > scores.shape[1]:
            more = top.shape[1] - scores.shape[1]
            scores = np.concatenate([scores, np.full((q_ids.size, more), low, dtype=scores.dtype)], axis=1)
            found = np.concatenate([found, np.full((q_ids.size, more), np.iinfo(np.int64).max)], axis=1)
        scores[live], found[live] = top, top_ids
        if top.shape[1] == how.k:
            k_th = np.where(top_ids[:, -1] == np.iinfo(np.int64).max, -np.inf, top[:, -1].astype(np.float64))
            stop[live] = np.maximum(stop[live], _lower(k_th))
    if scores is None:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), []], evaluated
    rows, places = np.nonzero(found != np.iinfo(np.int64).max)
    return [q_ids[rows], found[rows, places], scores[rows, places].tolist()], evaluated


def best_ranks(found: DataFrame, k: int, order: list) -> DataFrame:
    along = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= k)


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the farthest from those chosen before it."""
    chosen, gap = [0], np.full(sample.shape[0], np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        while len(chosen) < min(n, sample.shape[0]):
            gap = np.fmin(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(np.argmax(gap)))
    return sample[chosen]


def top_k(embeddings: DataFrame, is_query: Column, scale: int = 64, how: TopK = TopK()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of floor(scale * component), ties to smaller ids.

    Queries are the rows where ``is_query`` (on vec_id) holds, candidates all others than the query itself; see
    ``vectors.usable`` for what takes part; a vector whose scaled component is beyond all doubles does not. Scores are exact whole
    numbers; one that no long can hold is given as the nearest long, after ranking by its value (beyond 38 digits they tie). Fewer candidates than ``k`` give fewer rows; an empty table gives none. Work grows
    with queries times candidates: every lot of queries is led past every strip of candidates of its length once.
    """
    found = candidates(embeddings, is_query, scale, how)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = [F.desc("exact"), "vec_id"]
    return best_ranks(found.filter("vec_id is not null"), how.k, order).select("query_id", "rank", "vec_id", _as_long("exact").alias("score"))


def _as_long(name: str) -> Column:
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    return F.least(F.greatest(F.col(name), -top - 1), top).cast("long")


def candidates(embeddings: DataFrame, is_query: Column, scale: int = 64, how: TopK = TopK()) -> DataFrame | None:
    """query_id, vec_id, exact (decimal), evaluated: the best of every strip; per lot and strip one row with a null vec_id tells
    how many pairs were evaluated. None without usable vectors."""
    # From 2**53 on a double is whole, and beyond the longs floor() has no result.
    floor = lambda y: F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)
    whole = vs.usable(embeddings).withColumn("vec", F.transform("vec", lambda x: floor(x * scale)))
    whole = store(whole.filter(F.forall("vec", lambda x: F.abs(x) < float("inf"))))
    counts = {r.dim: r["count"] for r in whole.groupBy("dim").count().collect()}
    found = None
    for dim, n in sorted(counts.items()):
        part = _search(whole.filter(F.col("dim") == dim), n, is_query, how)
        found = part if found is None else found.union(part)
    return found


def _search(rows: DataFrame, n: int, is_query: Column, how: TopK) -> DataFrame:
    chosen = rows.select("vec_id", "vec", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(how.sample).collect()
    names, sample = np.array([r.vec_id for r in chosen]), np.array([r.vec for r in chosen], dtype=np.float64)
    pivots = _far_apart(sample, how.pivots)
    strips = -(-n // how.rows)
    lots = max(1, -(-n // (20 * how.queries)))
    lot_of = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count))

    def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, asks, ids, data in zip(*batch.columns, strict=True):
                q_ids, q = vs.unpack(ids, data)
                least = guaranteed(q_ids, q, names, sample, how.k) if asks.as_py() else np.zeros(0)
                columns = [[lot.as_py()], [asks.as_py()], [q_ids.tobytes()], [q.tobytes()], [distances(q, pivots).tobytes()], [least.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lot", "asks", "ids", "data", "pivots", "least"])

    blocks = vs.packed(rows, [], lot_of(strips)).select("lot", F.lit(False).alias("asks"), "ids", "data")
    asked = vs.packed(rows.filter(is_query), [], lot_of(lots)).select("lot", F.lit(True).alias("asks"), "ids", "data")
    schema = "lot long, asks boolean, ids binary, data binary, pivots binary, least binary"
    made = store(blocks.union(asked).mapInArrow(with_table, schema))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))).alias("lot")
    led = made.filter("asks").select(every, *made.columns[1:])
    dealt = made.filter("not asks").union(led).repartition(strips, "lot").sortWithinPartitions("lot", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = None
        for batch in batches:
            for lot, asks, ids, data, table, least in zip(*batch.columns, strict=True):
                ids, data = vs.unpack(ids, data)
                table = np.frombuffer(table.as_buffer(), dtype=np.float64).reshape(ids.size, -1)
                if not asks.as_py():
                    strip = (lot.as_py(), ids.copy(), data.copy(), table.copy())
                elif strip is not None and strip[0] == lot.as_py():
                    least = np.frombuffer(least.as_buffer(), dtype=np.float64)
                    (q_ids, names_, scores), evaluated = search_strip(ids, data, table, least, *strip[1:], how)
                    columns = [[*q_ids.tolist(), None], [*names_.tolist(), None], [*map(str, scores), None], [None] * len(scores) + [evaluated]]
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "exact", "evaluated"])

    out = dealt.mapInArrow(search, "query_id long, vec_id long, exact string, evaluated long")
    return out.withColumn("exact", F.col("exact").cast("decimal(38,0)"))
