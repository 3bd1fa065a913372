"""Merkle manifest of a table: a persistent tree whose versions copy the ancestors of one leaf and share all other nodes.

Every language has a tree over its documents in the order of their ids. Aligned blocks of ``fanout ** block_levels`` leaves are
folded each in a task, their tops form the leaves of the next tier, and so on up; the roots of the languages are folded the same
way. A proof leads down again: each block hands its leaves the siblings inside the block and those of the tiers above. A changed
leaf is a version of the tree: only its ancestors are made anew, inside its block and along the tiers above; all other nodes are
those of the stored tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.sequences import ordered
from rankloom.llm.tables import pick, store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Manifest:
    """``fanout`` consecutive nodes have one parent; a block holds ``block_levels`` levels."""

    fanout: int = 8
    block_levels: int = 3

    @property
    def block(self) -> int:
        return self.fanout**self.block_levels


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it; null is ``-``."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(field(c) for c in (doc_id, source, lang, n_chars, text))), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, changed): the digest of every row and that of its tampered form (null: not tampered with).

    Rows whose crc32 of the decimal doc_id is divisible by 3 are tampered with: A-Z of the text become lower case.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    docs = pick(documents, **{c: c for c in names})
    columns = [F.col(c) for c in names]
    lowered = F.translate("text", _UPPER, _LOWER)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        "lang", "doc_id", leaf_digest(*columns).alias("leaf"), F.when(hit, leaf_digest(*columns[:4], lowered)).alias("changed")
    )


def _h(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def levels(digests: list[str], n: int, how: Manifest) -> list[list[str]]:
    """The levels of one block from its nodes up, for a tree of ``n`` nodes; a tree of one node has no further level."""
    out = [digests]
    while n > 1 and len(out) <= how.block_levels:
        out.append([_h("".join(out[-1][i : i + how.fanout])) for i in range(0, len(out[-1]), how.fanout)])
        n = -(-n // how.fanout)
    return out


def _sides(level: list[str], i: int, fanout: int) -> tuple[str, str]:
    """The siblings of node ``i``, those on its left and those on its right, each as one text."""
    run = i - i % fanout
    return "".join(level[run:i]), "".join(level[i + 1 : run + fanout])


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _up(nodes: DataFrame, how: Manifest) -> DataFrame:
    """The next tier: the tops of all blocks."""

    def fold(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n, pos = table.column("n")[0].as_py(), table.column("pos")[0].as_py()
        made = levels(table.column("digest").to_pylist(), n, how)
        left = n
        for _ in made[1:]:
            left = -(-left // how.fanout)
        return pa.table({"tree": table.column("tree")[:1], "pos": pa.array([pos // how.block]), "n": pa.array([left]), "digest": pa.array(made[-1])})

    rows = nodes.select("tree", "pos", "n", "digest", F.floor(F.col("pos") / how.block).alias("block"))
    return rows.groupBy("tree", "block").applyInArrow(fold, "tree long, pos long, n long, digest string")


def tiers(nodes: DataFrame, how: Manifest) -> list[DataFrame]:
    """Stored (tree, pos, n, digest) of every tier; in the last one each tree is a single node."""
    out = [nodes]
    while not out[-1].filter("n > 1").isEmpty():
        out.append(store(_up(out[-1], how)))
    return out


def _down(nodes: DataFrame, above: DataFrame, how: Manifest) -> DataFrame:
    """(tree, pos, lefts, rights, subroot) of every node of a tier: its siblings level by level up to the root."""

    def lead(left: pa.Table, right: pa.Table) -> pa.Table:
        left, up = _sorted(left), right.to_pylist()[0]
        made = levels(left.column("digest").to_pylist(), left.column("n")[0].as_py(), how)[:-1]
        lefts, rights = [], []
        for i in range(left.num_rows):
            sides = [_sides(level, i // how.fanout**k, how.fanout) for k, level in enumerate(made)]
            lefts.append([s[0] for s in sides] + up["lefts"])
            rights.append([s[1] for s in sides] + up["rights"])
        kind = pa.list_(pa.string())
        return pa.table({
            "tree": left.column("tree"), "pos": left.column("pos"), "lefts": pa.array(lefts, kind), "rights": pa.array(rights, kind),
            "subroot": pa.array([up["subroot"]] * left.num_rows, pa.string()),
        })

    rows = nodes.select("tree", "pos", "n", "digest", F.floor(F.col("pos") / how.block).alias("block"))
    pairs = rows.groupBy("tree", "block").cogroup(above.groupBy("tree", "pos"))
    return pairs.applyInArrow(lead, "tree long, pos long, lefts array<string>, rights array<string>, subroot string")


def _versions(rows: DataFrame, above: DataFrame, root: str | None, how: Manifest) -> DataFrame:
    """Proof and version of every leaf. A version holds new nodes only on the way from its leaf to the root."""

    def lead(left: pa.Table, right: pa.Table) -> pa.Table:
        left, up = _sorted(left), right.to_pylist()[0]
        leaf, changed = left.column("leaf").to_pylist(), left.column("changed").to_pylist()
        made = levels(leaf, left.column("n")[0].as_py(), how)[:-1]
        rest = "".join(a + b for a, b in zip(up["lefts"], up["rights"], strict=True))
        sides = [[_sides(level, i, how.fanout) for i in range(len(level))] for level in made]
        over = list(zip(up["lefts"], up["rights"], strict=True))
        proofs, folded = [], []
        for i in range(len(leaf)):
            way = [side[i // how.fanout**k] for k, side in enumerate(sides)]
            proofs.append(_h("".join(a + b for a, b in way) + rest))
            node = changed[i] or leaf[i]
            for a, b in way + over:
                node = _h(a + node + b)
            folded.append(node)
        n = left.num_rows
        return pa.table({
            "tree": left.column("tree"), "pos": left.column("pos"), "doc_id": left.column("doc_id"), "leaf": left.column("leaf"),
            "subroot": pa.array([up["subroot"]] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == root for x in folded], pa.bool_()),
        })

    rows = rows.withColumn("block", F.floor(F.col("pos") / how.block))
    pairs = rows.groupBy("tree", "block").cogroup(above.groupBy("tree", "pos"))
    schema = "tree long, pos long, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return pairs.applyInArrow(lead, schema)


def manifest(documents: DataFrame, how: Manifest = Manifest()) -> DataFrame:
    """One row per document: tree, pos, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tree`` numbers the languages (null first, then by bytes), ``pos`` is the leaf's place in its tree. Leaves ascend by doc_id,
    null first; rows with one doc_id ascend by digest, equal rows are leaves side by side. A null doc_id is not tampered with. A
    row whose tampering changes nothing (no A-Z, null or empty text) verifies. An empty table gives no rows. Further columns are
    ignored.
    """
    found = store(leaves(documents))
    placed = store(ordered(found, "lang", [F.col("doc_id"), F.col("leaf")]))
    trees = store(placed.groupBy("lang").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)))
    trees = ordered(trees, "all", [F.col("lang")]).select(F.col("lang").alias("name"), F.col("pos").alias("tree"), "n")
    trees = store(trees)
    rows = placed.join(trees, placed["lang"].eqNullSafe(trees["name"])).select("tree", "pos", "n", "doc_id", "leaf", "changed")
    rows = store(rows)
    own = tiers(rows.select("tree", "pos", "n", F.col("leaf").alias("digest")), how)
    n_trees = trees.count()
    subroots = own[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "digest")
    upper = tiers(subroots, how)
    top = upper[-1].first()
    nothing = F.array().cast("array<string>")
    paths = upper[-1].select("tree", "pos", nothing.alias("lefts"), nothing.alias("rights"), F.lit(None).cast("string").alias("subroot"))
    for tier in reversed(upper[:-1]):
        paths = store(_down(tier, paths, how))
    paths = paths.join(subroots.select(F.col("pos").alias("p"), "digest"), F.col("pos") == F.col("p"))
    paths = paths.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("digest").alias("subroot"))
    for tier in reversed(own[1:-1]):
        paths = store(_down(tier, paths, how))
    return _versions(rows, paths, top.digest if top else None, how)
