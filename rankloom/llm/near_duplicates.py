"""Near duplicates by word shingles: MinHash bands find candidates, odd sketches order and screen them, full sets decide.

Texts with equal sets are one node. A band bucket is never expanded into its pairs: its members are compared with two
hubs, the member that shares most buckets of the corpus and one picked by a hash per bucket; odd sketches tell which hub is
nearest to a node, and which pair to two components. Only where a bucket's texts still lie in several components do those outside its
largest one meet the others, behind the parity bitmap of the whole set, which never rejects a link; of each two components the
nearest pair is tried first, and the other pairs only where that one fails.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import bitmaps as bm
from rankloom.llm import bytewords as bw
from rankloom.llm.components import connected
from rankloom.llm.tables import pick, row_key, store

SKETCH_BITS = 256
PARITY_BITS = 2048
_LANES = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_PARITY = [f"p{i}" for i in range(PARITY_BITS // 64)]
_SIGNATURE = "doc_id long, key_a long, key_b long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(
    f"{lane} long" for lane in (*_LANES, *_PARITY)
)


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters of the search.

    ``shingle`` words make a shingle; ``percent`` is the least 100 * intersection / union of a link. ``bands`` bands of
    ``rows`` MinHash values miss a pair at the threshold with probability ``(1 - (percent/100)**rows) ** bands`` (2e-7 here).
    Links with a hub are tried from an estimated similarity of ``sketch_floor`` on; they only save work, for what they leave
    open is compared without an estimate. ``block`` nodes of a bucket meet the whole bucket in one task.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 28
    rows: int = 3
    sketch_floor: float = 0.6
    block: int = 512

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def shingle_sets(block: bw.TextBlock, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a block; a text of fewer words has its whole sequence."""
    words = bw.find_words(block, bw.NON_SPACE)
    hashes = bw.word_hashes(words)
    grams, at = bw.gram_hashes(hashes, words.row, size)
    bounds = np.searchsorted(words.row[at], np.arange(block.rows + 1))
    first = words.first_of_row
    for i in range(block.rows):
        if words.counts[i] >= size:
            yield np.unique(grams[bounds[i] : bounds[i + 1]])
        elif words.counts[i]:
            yield np.array([bw.whole_hash(hashes[first[i] : first[i + 1]])], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def _set_digest(shingles: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _set_parity(shingles: np.ndarray) -> np.ndarray:
    """The shingles themselves folded into parity bits, as 64-bit lanes."""
    places = (bw.mix(shingles) % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def _min_hashes(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    least = np.full(factors.size, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, shingles.size, 4096):
        part = shingles[i : i + 4096]
        np.minimum(least, (factors[:, None] * part[None, :] + shifts[:, None]).min(axis=1), out=least)
    return least


def _permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    odd = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(1, 2**63, samples, dtype=np.uint64)


def _odd_sketch(least: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    """Fold the MinHash values of every row into parity bits: a row of 64-bit lanes each."""
    n = least.shape[0]
    places = (bw.mix(least ^ salt) % np.uint64(bits)).astype(np.int64) + np.arange(n)[:, None] * bits
    odd = (np.bincount(places.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, -1)


def signatures(docs: DataFrame, how: NearDuplicates) -> DataFrame:
    """Per row: number of shingles, the digest of its set, band keys, and in 64-bit lanes the odd sketch and the set's parity."""
    factors, shifts = _permutations(how.samples)
    salt = bw.mix(np.arange(1, how.samples + 1, dtype=np.uint64))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch.column("text")):
                sets = list(shingle_sets(block, how.shingle))
                sizes = np.array([s.size for s in sets])
                least = np.zeros((len(sets), how.samples), dtype=np.uint64)
                for i, s in enumerate(sets):
                    if s.size:
                        least[i] = _min_hashes(s, factors, shifts)
                lanes = _odd_sketch(least, salt, SKETCH_BITS)
                grouped = least.reshape(len(sets), how.bands, how.rows)
                keys = bw.mix((grouped * bw._PLACE[: how.rows]).sum(axis=2, dtype=np.uint64) + salt[: how.bands]).view(np.int64)
                parity = np.stack([_set_parity(s) for s in sets])
                digests = [_set_digest(s) if s.size else (None, None) for s in sets]
                here = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        here.column("doc_id"),
                        here.column("key_a"),
                        here.column("key_b"),
                        pa.array(sizes, pa.int64()),
                        *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)),
                        pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * how.bands, keys.ravel()),
                        *(pa.array(x[:, i]) for x in (lanes, parity) for i in range(x.shape[1])),
                    ],
                    names=["doc_id", "key_a", "key_b", "n_shingles", "set_a", "set_b", "bands", *_LANES, *_PARITY],
                )

    return docs.mapInArrow(per_batch, _SIGNATURE)


def _apart(a: str, b: str, lanes: list[str]) -> Column:
    """Differing bits of two bitmaps."""
    return sum((F.bit_count(F.col(f"{a}.{lane}").bitwiseXOR(F.col(f"{b}.{lane}"))) for lane in lanes), F.lit(0))


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    small = F.least(f"{a}.n_shingles", f"{b}.n_shingles")
    return small * 100 >= F.greatest(f"{a}.n_shingles", f"{b}.n_shingles") * percent


def _not_excluded(a: str, b: str, percent: int) -> Column:
    """No link fails this: a shingle of one set alone flips one parity bit, so the sets differ in at least as many shingles
    as bits, and a link of ``percent`` allows ``(100 - percent) / (100 + percent)`` of both sizes together."""
    allowed = (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")) * (100 - percent)
    return _apart(a, b, _PARITY) * (100 + percent) <= allowed


def _most_apart(bits: int, samples: int, similarity: float) -> int:
    """Differing bits to expect at a similarity: each sample that differs flips two bits."""
    return int(bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits)))


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, size): the nodes of every band bucket of two nodes or more."""
    rows = nodes.select(F.explode("bands").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return rows.join(shared, "key")


def _hub_links(members: DataFrame, nodes: DataFrame, how: NearDuplicates) -> DataFrame:
    """(a, b, apart): each node with the two hubs of each of its buckets, as far as the odd sketches allow a link."""
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    picked = members.join(weight, "node")
    hubs = picked.groupBy("key").agg(
        F.max(F.struct("weight", "node")).alias("common"),
        F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node")).alias("random"),
    )
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array("common.node", "random.node"))).alias("b"))
    pairs = members.select("key", F.col("node").alias("a")).join(hubs, "key").filter("a != b").select("a", "b").distinct()
    sketch = nodes.select("node", F.struct("n_shingles", *_LANES).alias("s"))
    both = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    apart = _apart("sa", "sb", _LANES)
    near = _sizes_allow("sa", "sb", how.percent) & (apart <= _most_apart(SKETCH_BITS, how.samples, how.sketch_floor))
    return both.filter(near).select("a", "b", apart.cast("long").alias("apart"))


def _labelled(df: DataFrame, node: str, root: str, labels: DataFrame) -> DataFrame:
    return df.join(labels.toDF(node, "_root"), node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")


def _open_pairs(members: DataFrame, labels: DataFrame, nodes: DataFrame, how: NearDuplicates) -> DataFrame:
    """(a, b, root_a, root_b, apart): pairs of a bucket in different components whose parity bits allow a link.

    In a bucket the nodes outside its largest component, cut into blocks, meet all nodes of the bucket; a bucket whose nodes hang
    together is closed.
    """
    sizes = labels.groupBy("root").agg(F.count("*").alias("weight"))
    labels = labels.join(sizes, "root").select("node", "root", "weight")
    rows = store(members.select("key", "node").join(labels, "node"))
    buckets = rows.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("weight", "root")).alias("top"), F.count("*").alias("size")
    )
    buckets = buckets.filter("low != high").select("key", F.col("top.root").alias("top"), F.ceil(F.col("size") / how.block).alias("blocks"))
    rows = rows.join(buckets, "key").select("key", "node", "root", "top", "blocks")
    rows = store(rows.join(nodes.select("node", F.struct("n_shingles", *_PARITY).alias("s")), "node"))
    few = rows.filter("root != top").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("top", "blocks")
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    every = every.toDF(*(f"{c}_2" for c in every.columns))
    meet = (F.col("key") == F.col("key_2")) & (F.col("block") == F.col("block_2"))
    meet &= (F.col("root") != F.col("root_2")) & ((F.col("root_2") == F.col("top_2")) | (F.col("root") < F.col("root_2")))
    meet &= _sizes_allow("s", "s_2", how.percent) & _not_excluded("s", "s_2", how.percent)
    per_mille = (_apart("s", "s_2", _PARITY) * 1000 / (F.col("s.n_shingles") + F.col("s_2.n_shingles"))).cast("long")
    found = few.join(every, meet).select(
        F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b"),
        F.when(F.col("node") < F.col("node_2"), F.col("root")).otherwise(F.col("root_2")).alias("root_a"),
        F.when(F.col("node") < F.col("node_2"), F.col("root_2")).otherwise(F.col("root")).alias("root_b"),
        per_mille.alias("apart"),
    )
    return found.distinct()


def _full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, how: NearDuplicates) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted``, made again from the text of one row of each.

    A bitmap of the wanted rows lets few others through, so that only their sets, and no text, are shuffled.
    """
    wanted = store(wanted.distinct().join(nodes.select("node", "row"), "node").select("node", "row.*"))
    row = F.xxhash64("key_a", "doc_id", "key_b").alias("row")
    bits = docs.sparkSession.sparkContext.broadcast(bm.bitmap(wanted.select(row)))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bm.known(bits.value)
        for batch in batches:
            batch = batch.filter(pa.array(known[bm.slots(batch.column("row").to_numpy())]))
            for block in bw.blocks(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(block, how.shingle)]
                here = batch.slice(block.first, block.rows)
                keys = [here.column(c) for c in ("doc_id", "key_a", "key_b")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(sets, pa.binary())], names=["id", "a", "b", "shingles"])

    made = docs.select("doc_id", "key_a", "key_b", "text", row).mapInArrow(per_batch, "id long, a long, b long, shingles binary")
    same = (F.col("a") == F.col("key_a")) & (F.col("b") == F.col("key_b")) & F.col("id").eqNullSafe(F.col("doc_id"))
    return store(made.join(wanted, same).select("node", "shingles").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b and further longs) whose full sets reach the threshold, stored."""
    names = pairs.columns
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * common >= percent * (x.size + y.size - common))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return store(both.select(*names, "set_a", "set_b").mapInArrow(per_batch, ", ".join(f"{c} long" for c in names)))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node")).union(links.select("b"))


def _components() -> list[Column]:
    return [F.least("root_a", "root_b").alias("u"), F.greatest("root_a", "root_b").alias("v")]


def _nearest(pairs: DataFrame) -> DataFrame:
    """(a, b, u, v): the nearest of the ``pairs`` (a, b, root_a, root_b, apart) of each two components u and v."""
    return store(pairs.groupBy(*_components()).agg(F.min(F.struct("apart", "a", "b")).alias("n")).select("n.a", "n.b", "u", "v"))


def _by_hubs(links: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all nodes, joined through hubs: each node tries its nearest hub, then each two components the nearest
    pair of a node and a hub between them."""
    first = links.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("n")).select("a", "n.b")
    good = _confirmed(first, sets, percent)
    labels = connected(good.select(F.col("a").alias("u"), F.col("b").alias("v")))
    apart = _labelled(_labelled(links, "a", "root_a", labels), "b", "root_b", labels).filter("root_a != root_b")
    roots = connected(_confirmed(_nearest(apart), sets, percent))
    placed = _labelled(nodes.select("node"), "node", "first", labels)
    return store(_labelled(placed, "first", "root", roots).select("node", "root"))


def _joined(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) over the components that the stored ``pairs`` connect: first the nearest pair of each two components, then
    all pairs of components that are still apart."""
    nearest = _nearest(pairs)
    good = _confirmed(nearest, sets, percent)
    labels = connected(good)
    rest = pairs.join(nearest.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", *_components())
    rest = _labelled(_labelled(rest, "u", "x", labels), "v", "y", labels).filter("x != y").select("a", "b", "u", "v")
    rest = store(rest)
    if rest.isEmpty():
        return labels
    return connected(good.union(_confirmed(rest, sets, percent)))


def near_duplicates(documents: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per document: doc_id, key_a, key_b, n_shingles, component_id, kept.

    Words are runs of anything but white space, A-Z in lower case. The set of a text is its distinct shingles; with fewer
    words its whole sequence; a null, empty or blank text has an empty set, links with nothing and is its own component.
    Repeated rows each give a row. ``component_id`` is the smallest non-null doc_id that the links reach; ``kept`` is
    true where it is the row's own (null equals null, so rows without any id in reach stay). ``key_a`` and ``key_b`` are
    digests of the text which tell rows with the same doc_id apart; such rows are placed each by its own text.
    An empty table gives no rows. Further columns are ignored.
    """
    docs = pick(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text", *row_key(F.col("text")))
    made = store(signatures(docs, how))
    lanes = [*_LANES, *_PARITY]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_a", "key_b", "n_shingles", "bands", *lanes))
    nodes = made.filter("set_a is not null").groupBy("set_a", "set_b").agg(best.alias("m")).select("set_a", "set_b", "m.*")
    row = F.struct("doc_id", "key_a", "key_b").alias("row")
    # The numbers are fixed by being stored; only their order among each other is used.
    nodes = store(nodes.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", row, "n_shingles", "bands", *lanes))
    members = store(_members(nodes))
    links = store(_hub_links(members, nodes, how))
    labels = _by_hubs(links, nodes, _full_sets(docs, nodes, _ends(links), how), how.percent)
    placed = nodes.select("set_a", "set_b", "node", F.col("row.doc_id").alias("id")).join(labels, "node")
    pairs = store(_open_pairs(members, labels, nodes, how))
    if not pairs.isEmpty():
        roots = _joined(pairs, _full_sets(docs, nodes, _ends(pairs), how), how.percent)
        placed = _labelled(placed.withColumnRenamed("root", "first"), "first", "root", roots)
    placed = store(placed.select("set_a", "set_b", "id", "root"))
    smallest = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    placed = placed.join(smallest, "root").select(F.col("set_a").alias("x"), F.col("set_b").alias("y"), "component_id")
    found = made.select("doc_id", "key_a", "key_b", "n_shingles", "set_a", "set_b")
    found = found.join(placed, (F.col("set_a") == F.col("x")) & (F.col("set_b") == F.col("y")), "left")
    component = F.when(F.col("set_a").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "key_a", "key_b", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
