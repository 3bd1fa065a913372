"""Ordered places and the manifest against plain Python."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from rankloom.llm.manifest import manifest
from rankloom.llm.sequences import BASE, ordered
from rankloom.llm.tables import store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, POS int"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fold(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]  # leaves first
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    leaf = lambda r, text: h(field(v) for v in (r[0], r[3], r[2], r[4], text))
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), i) for i, r in enumerate(rows) if r[2] == lang))
        trees.append((own, fold([x[2] for x in own])))
    upper = fold([levels[-1][0] for _, levels in trees])
    root = upper[-1][0] if rows else None
    for k, (own, levels) in enumerate(trees):
        for i, (_, _, digest, at) in enumerate(own):
            row = rows[at]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node, proof, place = leaf(row, lowered(row[1])) if hit else digest, "", i
            for part, place in ((levels, i), (upper, k)):
                for level in part[:-1]:
                    run = place - place % 8
                    left, right = level[run:place], level[place + 1 : run + 8]
                    proof, node, place = proof + "".join(left + right), h([*left, node, *right]), place // 8
            out.append((row[0], digest, levels[-1][0], root, h([proof]), node, node == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def plain(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str)


@pytest.mark.parametrize("size", [0, 1, 9, 700])
def test_manifest_equals_plain_python(spark, size):
    rng = random.Random(size)
    words = ["Alpha", "beta", "ÄÖ", "", "x " * 50, None]
    rows = [(i, rng.choice(words), "hot", "s", i, "x", 1) for i in range(size)]
    if size > 1:
        rows += [(None, "A", None, None, None, "x", 1), (None, "a", None, None, None, "x", 1), (5, "T", "ü", "s", 1, "x", 1), (5, "T", "ü", "s", 1, "x", 1)]
        rows += [(i, "Z", f"l{i}", "s", -i, "x", 1) for i in range(12)]
    rng.shuffle(rows)
    found = manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert plain(found) == sorted(brute_manifest(rows), key=str)
    assert size < 700 or {r.verified for r in found} == {True, False}


def test_places_of_a_key_that_lies_in_many_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 7, 7, 7, 7, 8, 9]), rng.randint(0, 10**6), rng.randint(-5, 5)) for _ in range(3000)]
    frame = store(spark.createDataFrame(rows, "k long, o long, v long").withColumn("d", F.xxhash64("v")))
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    found = ordered(frame, "k", [F.col("o"), F.col("v")], digests=("d",), sums=("v",)).collect()
    for k, v in kept.items():
        spark.conf.set(k, v)
    digests = {r.v: r.d for r in frame.select("v", "d").distinct().collect()}
    wanted = []
    for key in {r[0] for r in rows}:
        own, state, total = sorted((o, v) for k, o, v in rows if k == key), 0, 0
        for i, (o, v) in enumerate(own):
            before, state, total = state, (state * BASE + digests[v]) % 2**64, total + v
            signed = [x - 2**64 if x >= 2**63 else x for x in (before, state)]
            wanted.append((key, o, total, *signed, i, i == len(own) - 1))
    got = [(r.k, r.o, r.v, r.d_before, r.d, r.pos, r.last) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)


TURNS = "conv_id long, turn long, role string, text string, depth int, A string"


def brute_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends, saved, texts = {}, {}, {}, {(): ""}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: sum(1 for y in members if len(y) == len(x) + 1 and y[:-1] == x)
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        leaves = sum(1 for x in below if not kids(x))
        digest = sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids(node), leaves, saved, digest))
    return sorted(out, key=str)


def conversations(seed):
    rng, rows = random.Random(seed), []
    say = lambda: rng.choice(["", None, "hi", "ça va", "no"] if rng.random() < 0.8 else [f"t{rng.random()}"])
    for c in [*range(-130, -90), *range(-3, 60), 100, 101, *range(205, 240), *range(400, 460)]:
        for turn in range(rng.choice([1, 1, 2, 3, 7, 9])):
            rows.append((c, rng.choice([turn, turn, None, 2]), rng.choice(["user", "assistant", None]), say(), 1, "x"))
    rows += [(c, t, "user", "same", 1, "x") for c in (300, 301, 302, 303, 304, 305, 306) for t in range(12)]
    rows += [(c, t, "user", "long", 1, "x") for c in (500, 501) for t in range(60)] + rows[:5] + [(None, 1, "user", "nobody", 1, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie_equals_plain_python(spark, seed):
    from rankloom.llm.prefix_trie import PrefixTrie, prefix_trie

    rows = conversations(seed)
    how = PrefixTrie() if seed == 1 else PrefixTrie(rows=1, blocks=1)
    found = prefix_trie(spark.createDataFrame(rows, TURNS), how).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_trie(rows)


def test_prefixes_that_the_sketch_takes_for_shared_are_still_exact(spark, monkeypatch):
    """Every counter says two or more, or every second one, which also breaks a tail in the middle."""
    from rankloom.llm import prefix_trie as pt

    rows = conversations(3)[::3]
    for byte in (255, 0xAA):
        monkeypatch.setattr(pt, "several", lambda paths, how, real=pt.several, byte=byte: bytes(x | byte for x in real(paths, how)))
        found = pt.prefix_trie(spark.createDataFrame(rows, TURNS), pt.PrefixTrie(rows=1, blocks=1)).collect()
        monkeypatch.undo()
        assert sorted((tuple(r) for r in found), key=str) == brute_trie(rows)


def test_no_conversation_gives_no_node_and_one_without_turns_is_a_root(spark):
    from rankloom.llm.prefix_trie import prefix_trie

    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    c = next(i for i in range(1, 90) if zlib.crc32(str(i).encode()) % 6 > 0)
    rows = [(c, 0, "user", "gone", 1, "x")]
    assert [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, TURNS)).collect()] == brute_trie(rows)
