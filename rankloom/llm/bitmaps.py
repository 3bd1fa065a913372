"""Bitmaps of 64-bit hashes: 2 MB whatever the number of hashes, to let through what an exact join then decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 24
_BLOCK = 1 << 16


def bitmap(hashes: DataFrame) -> bytes:
    """A bit for the low bits of every hash in the only column (long) of ``hashes``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            for k in np.unique(slots // _BLOCK).tolist():
                blocks.setdefault(k, np.zeros(_BLOCK, bool))[slots[slots // _BLOCK == k] % _BLOCK] = True
        bits = [np.packbits(v).tobytes() for v in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(bits, pa.binary())], names=["block", "bits"])

    slots = hashes.toDF("hash").select(F.pmod("hash", F.lit(SLOTS)).alias("slot"))
    made = slots.repartition((F.col("slot") / _BLOCK).cast("int")).mapInArrow(pack, "block long, bits binary")
    out = [bytes(_BLOCK // 8)] * (SLOTS // _BLOCK)
    for row in made.collect():  # at most 256 rows of 8 KB
        out[row.block] = bytes(row.bits)
    return b"".join(out)


def known(bits: bytes) -> np.ndarray:
    """The bitmap as one boolean per slot."""
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)
