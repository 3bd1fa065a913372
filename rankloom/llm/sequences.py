"""Places and running values along ordered rows of a key, however many rows one key has.

Rows are range-sorted by key and order, so a key that holds a third of a table lies in many partitions. Every partition is
read once, in order; what its first key has before it is added afterwards from one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from rankloom.llm.tables import store

#: Running digests are polynomials in this odd number modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BACK = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _power(exponents: np.ndarray) -> np.ndarray:
    """BASE to each of the exponents."""
    out, square, left = np.ones(exponents.size, dtype=np.uint64), BASE, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        square, left = square * square & _MASK, left >> np.uint64(1)
    return out


def _bits(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def ordered(
    rows: DataFrame, key: str, order: list[Column], digests: tuple[str, ...] = (), sums: tuple[str, ...] = (), drop: tuple[str, ...] = ()
) -> DataFrame:
    """``rows`` with ``pos`` (place within the key, from 0) and ``last`` (no row of the key follows).

    Each column of ``digests`` (long) becomes the digest of the key's rows up to this one, and ``<name>_before`` that of the
    rows before it; equal runs of values have equal digests. Each column of ``sums`` (long) becomes its running sum. A null
    key is a key. ``rows`` should be cheap to read, for the range sort reads them twice. The columns ``drop`` serve the order alone
    and are left out of the result, which lies in the shared folder.
    """
    fields = [f for f in rows.schema.fields if f.name not in drop]
    extra = [T.StructField(f"{d}_before", T.LongType()) for d in digests]
    plain = T.StructType([*fields, *extra])
    marks = [T.StructField("pos", T.LongType()), T.StructField("last", T.BooleanType())]
    own = [T.StructField("_part", T.IntegerType()), *(T.StructField(n, T.BooleanType()) for n in ("_open", "_head", "_tail"))]
    local = T.StructType([*plain.fields, *marks, *own])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), [f.name for f in local.fields]
        waiting, held, carry, alone = None, None, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new = np.ones(n, dtype=bool)
            new[1:] = codes[1:] != codes[:-1]
            goes_on = held is not None and held[0] == keys[0].as_py()
            new[0] = not goes_on
            if waiting is not None:
                waiting["last"][-1] = not goes_on
                yield pa.RecordBatch.from_arrays([pa.array(waiting[c]) if isinstance(waiting[c], np.ndarray) else waiting[c] for c in names], names=names)
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at, 0))
            first = np.cumsum(new) == 0  # rows of the key that the batch before ended with
            out = {c: batch.column(c) for c in batch.schema.names}
            out["pos"] = at - begin + np.where(first, carry["pos"] if goes_on else 0, 0)
            state = {"pos": int(out["pos"][-1]) + 1}
            up, back = _powers(BASE, n + 1), _powers(_BACK, n + 1)
            for d in digests:
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_bits(batch.column(d)) * back[:n], dtype=np.uint64)))
                here = up[:n] * (total[1:] - total[begin])
                before = np.concatenate((np.zeros(1, np.uint64), here[:-1]))
                before[new] = 0
                if goes_on:
                    start = np.uint64(carry[d])
                    here[first] += start * up[1 : n + 1][first]
                    before[first] = np.concatenate((np.array([start]), here[:-1]))[first]
                out[d], out[f"{d}_before"], state[d] = here.view(np.int64), before.view(np.int64), int(here[-1])
            for s in sums:
                total = np.concatenate((np.zeros(1, np.int64), np.cumsum(batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64))))
                here = total[1:] - total[begin] + np.where(first, carry[s] if goes_on else 0, 0)
                out[s], state[s] = here, int(here[-1])
            last = np.ones(n, dtype=bool)
            last[:-1] = new[1:]
            opens = np.cumsum(new) == (1 if held is None else 0)  # the first key of the partition
            alone_here = opens & alone
            alone = bool(alone_here[-1])
            out |= {"last": last, "_part": np.full(n, part, np.int32), "_open": alone_here, "_head": (at == 0) & (held is None), "_tail": np.zeros(n, bool)}
            waiting, held, carry = out, (keys[n - 1].as_py(),), state
        if waiting is not None:
            waiting["_tail"][-1] = True
            yield pa.RecordBatch.from_arrays([pa.array(waiting[c]) if isinstance(waiting[c], np.ndarray) else waiting[c] for c in names], names=names)

    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).drop(*drop)
    made = store(dealt.mapInArrow(along, local))
    ends = made.filter("_head or _tail").select("_part", key, "pos", "_head", "_tail", *digests, *sums).collect()
    before, goes_on = _carried(ends, key, digests, sums)
    names = [f.name for f in (*plain.fields, *marks)]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: batch.column(c) for c in names}
            parts = batch.column("_part").to_numpy()
            opens, tail = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_open", "_tail"))
            for p in np.unique(parts).tolist():
                if p in goes_on:
                    kept = np.asarray(out["last"].to_numpy(zero_copy_only=False)).copy()
                    kept[(parts == p) & tail] = False
                    out["last"] = pa.array(kept)
                if p not in before:
                    continue
                rows_here, start = (parts == p) & opens, before[p]
                pos = out["pos"].to_numpy(zero_copy_only=False)
                factor = _power(np.where(rows_here, pos, 0))
                for d in digests:
                    h0 = np.uint64(start[d])
                    for name, scale in ((d, factor * np.uint64(BASE)), (f"{d}_before", factor)):
                        out[name] = pa.array(np.where(rows_here, h0 * scale + _bits(out[name]), _bits(out[name])).view(np.int64))
                for s in sums:
                    out[s] = pa.array(out[s].to_numpy(zero_copy_only=False) + np.where(rows_here, start[s], 0))
                out["pos"] = pa.array(pos + np.where(rows_here, start["pos"], 0))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return made.mapInArrow(settle, T.StructType([*plain.fields, *marks]))


def _carried(ends: list, key: str, digests: tuple[str, ...], sums: tuple[str, ...]) -> tuple[dict, set]:
    """From the first and last row of every partition: what lies before its first key's rows, and the partitions whose last
    key goes on in the next one."""
    heads = {r["_part"]: r[key] for r in ends if r["_head"]}
    tails = {r["_part"]: r for r in ends if r["_tail"]}
    before: dict[int, dict] = {}
    goes_on: set[int] = set()
    state, state_key, previous = None, None, None
    for part in sorted(heads):
        tail = tails[part]
        now = {"pos": tail["pos"] + 1, **{d: tail[d] & _MASK for d in digests}, **{s: tail[s] for s in sums}}
        if state is not None and state_key == heads[part]:
            before[part] = state
            goes_on.add(previous)
            if tail[key] == heads[part]:
                step = pow(BASE, now["pos"], 1 << 64)
                now = {
                    "pos": state["pos"] + now["pos"],
                    **{d: (state[d] * step + now[d]) & _MASK for d in digests},
                    **{s: state[s] + now[s] for s in sums},
                }
        state, state_key, previous = now, tail[key], part
    return before, goes_on
