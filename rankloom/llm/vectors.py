"""Vectors of a table as blocks: one row holds many vectors, so that a pair of blocks is one unit of work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import pick


def usable(embeddings: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, vec, dim): vectors with an id, at least one component and only finite ones; optionally not all zero.

    A vec_id that occurs more than once takes part with its smallest vector. Only vectors of one length are compared.
    """
    rows = pick(embeddings, vec_id="vec_id", vec="embedding")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("vec").cast("array<double>")).filter("vec_id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.filter(finite)
    if nonzero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def packed(rows: DataFrame, keys: list[str], lot: Column) -> DataFrame:
    """``keys``, ids (longs as bytes) and data (doubles as bytes), one row per lot; ``lot`` bounds the rows of a block."""
    made = rows.groupBy(*keys, lot.alias("lot")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vec"))).alias("v"))
    flat = made.select(*keys, "lot", F.col("v.vec_id").alias("ids"), F.flatten("v.vec").alias("data"))
    kinds = ", ".join(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in [*keys, "lot"])

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(k) for k in [*keys, "lot"]]
            for name in ("ids", "data"):
                out.append(pa.array([row.values.to_numpy().tobytes() for row in batch.column(name)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "lot", "ids", "data"])

    return flat.mapInArrow(to_bytes, f"{kinds}, ids binary, data binary")


def unpack(ids: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids.as_buffer(), dtype=np.int64)
    return names, np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(names.size, -1)
