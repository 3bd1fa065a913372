"""Token counts that follow edits: a kept tree of pre-token counts per text, of which an edit renews only the part it touches.

``plant`` makes a table of trees, ``edited`` applies edits to such a table and gives the table of the renewed trees, which takes
further edits. A tree has one leaf per pre-token (its characters and tokens); leaves stand in blocks, and over the blocks stands a
segment tree of sums. An edit puts new leaves into the blocks it touches and renews the sums on their paths to the root.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankloom.llm.tables import pick, row_key, store

Edit = tuple[int, int, str]
#: Pre-tokens whose counts a task keeps.
KEPT = 200_000
#: Leaves of a block when a tree is planted; a block that grows to ``CROWDED`` makes the tree of its text be dealt anew.
BLOCK = 64
CROWDED = 4 * BLOCK
#: Rows that are worked on together, and the characters of their texts from which on they go out.
BATCH_ROWS = 512
BATCH_CHARS = 1_000_000

#: Pre-tokens as the byte-level BPE vocabularies in use split them (fixed value, part of the tokenizer).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What the registered query edits: addresses and long runs of digits give way to a mark.
REDACTIONS = ((r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<address>"), (r"(?<!\d)\d{9,}(?!\d)", "<number>"))

TREE = "sizes array<int>, chars array<int>, counts array<int>, char_sums array<long>, token_sums array<long>"
KEYED = "doc_id long, key_a long, key_b long, text string"
_KEYS = ["doc_id", "key_a", "key_b"]
_TALLY = ["n_edits", "n_renewed"]


class Counter:
    """Token counts of pre-tokens by the lines of a vocabulary file; keeps those it has seen, up to a fixed number."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, vocabulary.splitlines()) if word}
        self.coder = tiktoken.Encoding("counts", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PRE_TOKEN).findall
        self.match = regex.compile(PRE_TOKEN).match
        self.kept: dict[str, int] = {}

    def count(self, pre_tokens: list[str]) -> list[int]:
        kept = self.kept
        try:
            return list(map(kept.__getitem__, pre_tokens))
        except KeyError:
            fresh = set(pre_tokens).difference(kept)
            if len(kept) + len(fresh) > KEPT:
                kept.clear()
                fresh = set(pre_tokens)
            for word in fresh:
                kept[word] = len(self.coder.encode_ordinary(word))
            return list(map(kept.__getitem__, pre_tokens))


def _sums(leaves: list[int]) -> list[list[int]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sum(below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def _levels(flat: Sequence[int], width: int) -> list[list[int]]:
    """The levels of sums, lowest first, from their one list."""
    levels, at = [list(flat[:width])], width
    while width > 1:
        width = (width + 1) // 2
        levels.append(list(flat[at : at + width]))
        at += width
    return levels


class CountTree:
    """The leaves of one text in blocks, and the sums of characters and tokens over the blocks, lowest level first."""

    def __init__(self, blocks: list[tuple[list[int], list[int]]], char_sums: list[list[int]], token_sums: list[list[int]]):
        self.blocks, self.char_sums, self.token_sums = blocks, char_sums, token_sums

    @classmethod
    def planted(cls, chars: list[int], counts: list[int]) -> CountTree:
        places = range(0, max(len(chars), 1), BLOCK)
        blocks = [(chars[i : i + BLOCK], counts[i : i + BLOCK]) for i in places]
        return cls(blocks, _sums([sum(c) for c, _ in blocks]), _sums([sum(n) for _, n in blocks]))

    @classmethod
    def of(cls, text: str, counter: Counter) -> CountTree:
        words = counter.split(text)
        return cls.planted(list(map(len, words)), counter.count(words))

    @classmethod
    def read(cls, row: dict) -> CountTree:
        blocks, at = [], 0
        for size in row["sizes"]:
            blocks.append((row["chars"][at : at + size], row["counts"][at : at + size]))
            at += size
        return cls(blocks, _levels(row["char_sums"], len(blocks)), _levels(row["token_sums"], len(blocks)))

    def row(self) -> dict:
        return {
            "sizes": [len(c) for c, _ in self.blocks],
            "chars": [x for c, _ in self.blocks for x in c],
            "counts": [x for _, n in self.blocks for x in n],
            "char_sums": [x for level in self.char_sums for x in level],
            "token_sums": [x for level in self.token_sums for x in level],
        }

    @property
    def total(self) -> int:
        return self.token_sums[-1][0]

    def place(self, char: int) -> tuple[int, int, int]:
        """(block, leaf in it, characters before it) behind the last leaf that ends at ``char`` or before."""
        node, past = 0, 0
        for level in self.char_sums[-2::-1]:
            node *= 2
            if node + 1 < len(level) and past + level[node] <= char:
                past += level[node]
                node += 1
        leaf = 0
        for size in self.blocks[node][0]:
            if past + size > char:
                break
            past += size
            leaf += 1
        return node, leaf, past

    def replace(self, splices: list[tuple[tuple[int, int], tuple[int, int], list[int], list[int]]]) -> None:
        """Each splice (from, to, chars, counts) puts new leaves in place of those between two places; splices stand in order."""
        touched: set[int] = set()
        for (first, i), (last, j), chars, counts in reversed(splices):
            for side, fresh in ((0, chars), (1, counts)):
                if first == last:
                    self.blocks[first][side][i:j] = fresh
                else:
                    self.blocks[first][side][i:] = fresh
                    for between in range(first + 1, last):
                        self.blocks[between][side].clear()
                    del self.blocks[last][side][:j]
            touched.update(range(first, last + 1))
        if any(len(self.blocks[b][0]) >= CROWDED for b in touched):
            row = self.row()
            self.__dict__.update(CountTree.planted(row["chars"], row["counts"]).__dict__)
            return
        for side, sums in ((0, self.char_sums), (1, self.token_sums)):
            for b in touched:
                sums[0][b] = sum(self.blocks[b][side])
            nodes = touched
            for below, above in zip(sums, sums[1:]):
                nodes = {n // 2 for n in nodes}
                for n in nodes:
                    above[n] = sum(below[2 * n : 2 * n + 2])


def apply_edits(text: str, edits: list[Edit]) -> str:
    """The text with (start, stop, replacement) put in; edits are sorted and do not overlap."""
    out, at = [], 0
    for start, stop, new in edits:
        out += [text[at:start], new]
        at = stop
    return "".join([*out, text[at:]])


def follow(tree: CountTree, text: str, edits: list[Edit], counter: Counter) -> tuple[str, int]:
    """Brings the tree of ``text`` in line with the edits: the edited text, and the number of pre-tokens encoded anew.

    Splitting has no memory beyond the place it is at and looks one character past a pre-token, so the pre-tokens that end
    two characters before an edit stay. From there the edited text is split anew until, behind the edit, a split falls on an
    old one; all after it is unchanged. Edits within the part split anew are taken along.
    """
    edited = apply_edits(text, edits)
    splices, renewed, shift, i = [], 0, 0, 0
    while i < len(edits):
        start, stop, new = edits[i]
        *first, past = tree.place(start - 2)
        at = past + shift
        shift += len(new) - (stop - start)
        fresh: list[str] = []
        while True:
            old = at - shift
            while i + 1 < len(edits) and old > edits[i + 1][0] - 2:
                i += 1
                start, stop, new = edits[i]
                shift += len(new) - (stop - start)
                old = at - shift
            if old >= stop:
                *last, past = tree.place(old)
                if past == old:
                    break
            found = counter.match(edited, at)
            if found is None:
                *last, _ = tree.place(len(text))
                break
            fresh.append(found[0])
            at = found.end()
        splices.append((tuple(first), tuple(last), list(map(len, fresh)), counter.count(fresh)))
        renewed += len(fresh)
        i += 1
    tree.replace(splices)
    return edited, renewed


def redactions(text: str, rules: tuple[tuple[str, str], ...] = REDACTIONS) -> list[Edit]:
    """The edits of the rules, from left to right; of two that overlap the earlier one counts."""
    found = sorted((m.start(), m.end(), new) for pattern, new in rules for m in regex.finditer(pattern, text))
    out: list[Edit] = []
    for edit in found:
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def _usable(edits: list[dict] | None, size: int) -> list[Edit]:
    """Edits of a table as they are applied: sorted, inside the text; of two that overlap the earlier one counts."""
    out: list[Edit] = []
    for start, stop, new in sorted((e["start"], e["stop"], e["new"] or "") for e in edits or ()):
        if 0 <= start <= stop <= size and (not out or start >= out[-1][1]):
            out.append((start, stop, new))
    return out


def _vocabulary(df: DataFrame, ranks_path: str):
    """The vocabulary file, sent to the executors; its size is that of the vocabulary."""
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def plant(documents: DataFrame, ranks_path: str) -> DataFrame:
    """One row per row: doc_id, key_a, key_b (digests of the text), text, and its tree: ``sizes`` (leaves of each block), ``chars``
    and ``counts`` (of each leaf), ``char_sums`` and ``token_sums`` (levels over the blocks, lowest first; the last is the whole).

    A null text stays null and has the tree of an empty one, which has no leaf. Repeated rows each have a tree; ids may be null; an
    empty table gives no rows; further columns are ignored.
    """
    vocabulary = _vocabulary(documents, ranks_path)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for batch in batches:
            rows, first, size = _Rows(), 0, 0
            for i, text in enumerate(batch.column("text")):
                said = text.as_py() or ""
                rows.add(CountTree.of(said, counter))
                size += len(said)
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    yield _with(batch.slice(first, i + 1 - first), rows.columns())
                    rows, first, size = _Rows(), i + 1, 0

    docs = pick(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), *row_key(F.col("text")), "text")
    return docs.mapInArrow(per_batch, f"{KEYED}, {TREE}")


_ARROW = {"sizes": pa.int32(), "chars": pa.int32(), "counts": pa.int32(), "char_sums": pa.int64(), "token_sums": pa.int64()}


class _Rows:
    """Trees as flat columns."""

    def __init__(self):
        self.flat = {name: array("i" if kind == pa.int32() else "q") for name, kind in _ARROW.items()}
        self.ends = {name: array("i", [0]) for name in _ARROW}

    def add(self, tree: CountTree) -> None:
        flat = self.flat
        for chars, counts in tree.blocks:
            flat["sizes"].append(len(chars))
            flat["chars"].extend(chars)
            flat["counts"].extend(counts)
        for name, sums in (("char_sums", tree.char_sums), ("token_sums", tree.token_sums)):
            for level in sums:
                flat[name].extend(level)
        for name, ends in self.ends.items():
            ends.append(len(flat[name]))

    def columns(self) -> dict[str, pa.Array]:
        return {
            name: pa.ListArray.from_arrays(pa.array(np.asarray(self.ends[name])), pa.array(np.asarray(self.flat[name]), kind))
            for name, kind in _ARROW.items()
        }


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with these columns, new ones at the end."""
    return pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | columns)


def _followed(batch: pa.RecordBatch, edits: dict[int, list[Edit]], counter: Counter) -> pa.RecordBatch:
    """The rows of the batch that have edits, with their renewed trees."""
    texts, rows, renewed = [], _Rows(), []
    for i, found in edits.items():
        tree = CountTree.read({name: batch.column(name)[i].as_py() for name in _ARROW})
        text, n = follow(tree, batch.column("text")[i].as_py() or "", found, counter)
        texts.append(text)
        rows.add(tree)
        renewed.append(n)
    tallies = {"n_edits": pa.array(map(len, edits.values()), pa.int64()), "n_renewed": pa.array(renewed, pa.int64())}
    return _with(batch.take(pa.array(edits)), {"text": pa.array(texts, pa.string())} | rows.columns() | tallies)


def edited(trees: DataFrame, ranks_path: str, edits: DataFrame | Callable[[str], list[Edit]]) -> DataFrame:
    """The trees of the edited texts, with ``n_edits`` (applied) and ``n_renewed`` (pre-tokens encoded anew) of this round.

    ``edits`` is a table (doc_id, key_a, key_b, start, stop, new) joined by the keys of ``trees``, or a function that gives the
    edits of a text. The keys stay those of the text that was planted, so that further tables of edits find their trees. Edits
    outside the text or without a start or stop are left out, of two that overlap the earlier one counts; a null ``new`` is
    empty. A null text takes an edit at 0 as an empty one. Trees without edits, and further columns of ``trees``, go through as
    they are; an empty table gives no rows.
    """
    vocabulary = _vocabulary(trees, ranks_path)
    trees = trees.drop(*_TALLY)
    names = trees.columns
    schema = StructType([*trees.schema.fields, *(StructField(t, LongType()) for t in _TALLY)])
    by_text = edits if callable(edits) else None
    if by_text is None:
        one = F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("new").cast("string").alias("new"))
        usable = pick(edits, **{c: c for c in (*_KEYS, "start", "stop", "new")}).filter("start is not null and stop is not null")
        per_text = usable.groupBy(*(F.col(k).alias(f"_of_{k}") for k in _KEYS)).agg(F.collect_list(one).alias("_edits"))
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in _KEYS]
        trees = trees.join(per_text, same, "left").select(*names, "_edits")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                yield from per_part(whole.slice(at, BATCH_ROWS), counter)

    def per_part(batch: pa.RecordBatch, counter: Counter) -> Iterator[pa.RecordBatch]:
        plain, still, found, size = batch.select(names), [], {}, 0
        for i, text in enumerate(batch.column("text")):
            said = text.as_py() or ""
            here = by_text(said) if by_text else _usable(batch.column("_edits")[i].as_py(), len(said))
            still.append(not here)
            if here:
                found[i] = here
                size += len(said)
            if size >= BATCH_CHARS:
                yield _followed(plain, found, counter)
                found, size = {}, 0
        if found:
            yield _followed(plain, found, counter)
        rest = plain.filter(pa.array(still, pa.bool_()))
        yield _with(rest, {t: pa.array([0] * rest.num_rows, pa.int64()) for t in _TALLY})

    return trees.mapInArrow(per_batch, schema)


def total() -> Column:
    """The tokens of a text: the sum at the root of its tree."""
    return F.element_at("token_sums", -1)


def edit_counts(documents: DataFrame, ranks_path: str, rules: tuple[tuple[str, str], ...] = REDACTIONS) -> DataFrame:
    """One row per row: doc_id, n_tokens (whole text), n_edits, n_tokens_after, n_renewed (pre-tokens encoded anew).

    The trees of all texts are stored, and the edits of the rules (pattern, replacement) are applied to the stored trees. A null
    or empty text has no tokens and no edits. Repeated rows each give a row; an empty table gives no rows; further columns are
    ignored.
    """
    trees = store(plant(documents, ranks_path), compression="zstd").withColumn("n_tokens", total())
    after = edited(trees, ranks_path, partial(redactions, rules=rules))
    return after.select("doc_id", "n_tokens", "n_edits", total().alias("n_tokens_after"), "n_renewed")
