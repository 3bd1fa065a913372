"""Prefix trie of conversations: every distinct run of first turns is a node.

Each turn of a conversation is a prefix, known by the digest of its turns. A count-min sketch of all prefix digests tells which
prefixes only one conversation has: an estimate of one is never too low, so it proves a singleton. What follows a singleton is a
tail of its own conversation and becomes rows without meeting any other; only prefixes that may be shared are grouped. Sums over
subtrees need no walk along the depth: every node is counted for its smallest member, so a subtree's sum is the sum, over the
members of its top, of what lies below on their own paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import bytewords as bw
from rankloom.llm.sequences import ordered
from rankloom.llm.tables import pick, store

NODE = ["depth", "a", "b"]
_BLOCK = 1 << 16


@dataclass(frozen=True)
class PrefixTrie:
    """The sketch has ``rows`` rows of ``blocks`` times 65,536 counters, whatever the input: a larger input only lets more
    prefixes through to the exact grouping. Driver and tasks hold one bit per counter (786 KB)."""

    rows: int = 3
    blocks: int = 32


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, a, b, chars): null role or text is empty; rows without a conv_id take no part."""
    rows = pick(conversations, **{c: c for c in ("conv_id", "turn", "role", "text")}).filter("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long"), "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    said = {x: F.xxhash64(F.lit(x), "role", "text") for x in ("a", "b")}
    return rows.withColumns({**said, "chars": F.length("text").cast("long")})


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, part, at, a, b, chars) of all rebuilt turns, and (conv) of all conversations.

    A conversation c begins with the first h turns of conversation c - c % 100, h being crc32 of the decimal c modulo 6, and goes
    on with its own turns after its first h. Turns ascend by turn (null first), then by role and text.
    """
    turns = turn_digests(conversations)
    order = ["turn", "role", "text"]
    placed = store(ordered(turns, "conv_id", [F.col(c) for c in order], drop=tuple(order)))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    said = ["a", "b", "chars"]
    convs = placed.filter("pos = 0").select(F.col("conv_id").alias("conv"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    convs = store(convs)
    own = placed.filter(F.col("pos") >= h).select(F.col("conv_id").alias("conv"), F.lit(1).alias("part"), F.col("pos").alias("at"), *said)
    first = placed.filter("conv_id % 100 = 0 and pos < 5")
    first = convs.join(first, (F.col("base") == F.col("conv_id")) & (F.col("pos") < F.col("h")))
    first = first.select("conv", F.lit(0).alias("part"), F.col("pos").alias("at"), *said)
    return store(own.union(first)), convs.select("conv")


def _slots(depth: np.ndarray, a: np.ndarray, b: np.ndarray, how: PrefixTrie) -> Iterator[np.ndarray]:
    """The counter of every prefix in each row of the sketch, numbered over all rows."""
    seed = a.view(np.uint64) + bw.mix(b.view(np.uint64) + depth.astype(np.uint64))
    width = np.uint64(how.blocks * _BLOCK)
    for r in range(how.rows):
        yield (bw.mix(seed ^ bw.mix(np.array([r + 1], np.uint64))) % width).astype(np.int64) + r * int(width)


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def several(paths: DataFrame, how: PrefixTrie) -> bytes:
    """A bit for every counter of the count-min sketch over all prefixes: whether it counted two or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(how.rows * how.blocks * _BLOCK, dtype=np.uint8)
        for batch in batches:
            for slots in _slots(*_longs(batch, *NODE), how):
                at, n = np.unique(slots, return_counts=True)
                seen[at] = np.minimum(seen[at] + np.minimum(n, 2), 2)
        for k, block in enumerate(seen.reshape(-1, _BLOCK)):
            if block.any():
                once, more = (np.flatnonzero(block == n).astype(np.uint16).tobytes() for n in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([once]), pa.array([more])], names=["block", "once", "more"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, once, more in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "more")), strict=True):
                total = blocks.setdefault(k, np.zeros(_BLOCK, dtype=np.uint8))
                at = np.frombuffer(once, dtype=np.uint16)
                total[at] = np.minimum(total[at] + 1, 2)
                total[np.frombuffer(more, dtype=np.uint16)] = 2
        bits = [np.packbits(v == 2).tobytes() for v in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(bits, pa.binary())], names=["block", "bits"])

    counted = paths.select(*NODE).mapInArrow(count, "block long, once binary, more binary")
    summed = counted.repartition("block").mapInArrow(add, "block long, bits binary")
    out = [bytes(_BLOCK // 8)] * (how.rows * how.blocks)
    for row in summed.collect():  # one row per block of the sketch
        out[row.block] = bytes(row.bits)
    return b"".join(out)


def screened(paths: DataFrame, how: PrefixTrie) -> DataFrame:
    """``paths`` with ``kind``: 0 a node inside a tail, 1 the first node of a tail, 2 a node that may be shared."""
    bits = paths.sparkSession.sparkContext.broadcast(several(paths, how))
    schema = "conv long, depth long, a long, b long, a_before long, b_before long, chars long, last boolean, kind int"
    names = [x.split()[0] for x in schema.split(", ")]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8)).astype(bool)

        def shared(depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.logical_and.reduce([known[slots] for slots in _slots(depth, a, b, how)])

        for batch in batches:
            depth, a, b, a0, b0 = _longs(batch, *NODE, "a_before", "b_before")
            above = (depth == 1) | shared(depth - 1, a0, b0)
            kind = np.where(above, np.where(shared(depth, a, b), 2, 1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(kind)], names=names)

    return paths.select(*names[:-1]).mapInArrow(check, schema)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends): SHA-256 of the ascending members, comma-joined. The members of a node are joined where the range sort
    has put them; one task then reads the joined pieces of a node in order, each as it comes."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _longs(batch, *NODE, "conv")
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns[:3]])
            at = [*np.flatnonzero(new).tolist(), batch.num_rows]
            convs = columns[3].tolist()
            text = [",".join(map(str, convs[i:j])) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[new]) for x in columns), pa.array(text)], names=[*NODE, "conv", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "text")), strict=True):
                if key != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _rows(done)
        yield _rows([(*node, digest.hexdigest())] if node else [])

    def _rows(done: list) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends"])

    pieces = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(joined, "depth long, a long, b long, conv long, text string")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "conv")
    return pieces.mapInArrow(hashed, "depth long, a long, b long, ends string")


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def trie(turns: DataFrame, convs: DataFrame, how: PrefixTrie = PrefixTrie()) -> DataFrame:
    """The nodes of the prefixes of ``turns`` (conv, part, at, a, b, chars; ordered by part and at) of the conversations ``convs``.

    Per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Conversations without turns are members of the root and end there. No conversation, no rows.
    """
    paths = ordered(turns, "conv", [F.col("part"), F.col("at")], digests=("a", "b"))
    rows = store(screened(paths.withColumn("depth", F.col("pos") + 1), how))
    convs = store(convs)
    tail, stub, open_ = (rows.filter(F.col("kind") == k) for k in (0, 1, 2))

    groups = open_.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("a_before").alias("pa"), F.max("b_before").alias("pb")
    )
    groups = store(groups)
    parents = groups.select((F.col("depth") - 1).alias("depth"), "pa", "pb")
    parents = parents.union(stub.select(F.col("depth") - 1, "a_before", "b_before")).toDF(*NODE)
    children = store(parents.groupBy(*NODE).agg(F.count("*").alias("children")))
    nodes = store(groups.join(children, NODE, "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))))

    # Down each conversation's own path: what the nodes that it stands for save, and whether it ends in a leaf of its own.
    member = open_.select(*NODE, "conv", "last").join(nodes.select(*NODE, F.col("conv").alias("least"), "n", "chars", "children"), NODE)
    stands = F.col("conv") == F.col("least")
    saved = F.when(stands, (F.col("n") - 1) * F.col("chars")).otherwise(0).cast("long")
    leaf = ((F.col("n") == 1) | (stands & F.col("last") & (F.col("children") == 0))).cast("long")
    member = member.select(*NODE, "conv", saved.alias("saved"), leaf.alias("leaf"), F.lit(True).alias("open"))
    begun = stub.select(*NODE, "conv", F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(False))
    below = ordered(store(member.union(begun).withColumn("up", -F.col("depth"))), "conv", [F.col("up")], sums=("saved", "leaf"), drop=("up",))
    below = store(below.withColumn("leaf", (F.col("leaf") > 0).cast("long")))
    sums = below.filter("open").groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))

    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).first()
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    first = F.when(F.col("depth") == 1, F.lit(top.conv))
    still = convs.join(rows.filter("depth = 1").select("conv"), "conv", "left_anti")
    zero = F.lit(0).cast("long")
    still = still.select("conv", *(zero.alias(c) for c in NODE))
    ends = store(open_.filter("last").select("conv", *NODE).union(still))
    ended = store(_end_digests(ends))

    def shape(df: DataFrame, **columns: Column) -> DataFrame:
        kinds = {"ends_sha256": "string"}
        return df.select(*(c.cast(kinds.get(name, "long")).alias(name) for name, c in columns.items()))

    alone = {"n_convs": F.lit(1), "n_children": (~F.col("last")).cast("long"), "n_leaves": F.lit(1), "saved_tokens": F.lit(0)}
    alone["ends_sha256"] = _sha(F.when(F.col("last"), F.col("conv").cast("string")).otherwise(""))
    tails = shape(tail, conv_id=F.col("conv"), depth=F.col("depth"), parent_conv_id=F.col("conv"), **alone)
    stubs = stub.withColumnsRenamed({"a_before": "pa", "b_before": "pb"}).join(above, ["depth", "pa", "pb"], "left")
    stubs = shape(stubs, conv_id=F.col("conv"), depth=F.col("depth"), parent_conv_id=F.coalesce(first, "parent", "conv"), **alone)
    inner = nodes.join(above, ["depth", "pa", "pb"], "left").join(sums, NODE).join(ended, NODE, "left")
    inner = shape(
        inner, conv_id=F.col("conv"), depth=F.col("depth"), parent_conv_id=F.coalesce(first, "parent", "conv"), n_convs=F.col("n"),
        n_children=F.col("children"), n_leaves=F.col("leaves"), saved_tokens=F.col("saved"), ends_sha256=F.coalesce("ends", _sha(F.lit(""))),
    )
    none = F.lit(None)
    whole = below.filter("depth = 1").select("saved", "leaf", none.cast("long").alias("children"), none.cast("string").alias("ends"))
    whole = whole.union(children.filter("depth = 0").select(zero, zero, "children", none.cast("string")))
    whole = whole.union(ended.filter("depth = 0").select(zero, zero, none.cast("long"), "ends"))
    whole = whole.agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.max("children").alias("children"), F.max("ends").alias("ends"))
    leaves = F.when(F.col("children") > 0, F.col("leaf")).otherwise(1)
    root = shape(
        whole.filter(F.lit(top.n > 0)), conv_id=F.lit(top.conv), depth=zero, parent_conv_id=F.lit(None), n_convs=F.lit(top.n), n_children=F.coalesce("children", zero),
        n_leaves=leaves, saved_tokens=F.coalesce("saved", zero), ends_sha256=F.coalesce("ends", _sha(F.lit(""))),
    )
    return tails.union(stubs).union(inner).union(root)


def prefix_trie(conversations: DataFrame, how: PrefixTrie = PrefixTrie()) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt`` and ``trie``).

    Equal turns of equal number are equal steps whatever row they come from; repeated rows are turns of their own. Empty texts
    save nothing. An empty table, or one without any conv_id, gives no rows. Further columns are ignored.
    """
    return trie(*rebuilt(conversations), how)
