"""Repeated passages by hashing normalised units: lines, cut further at the ends of sentences.

Every unit is digested from its normalised words, digests are grouped over all texts, the earliest occurrence by rank stays
and the others are removed; all spans are character offsets in the original text. Cutting lines at sentence ends gives a
passage that was set into a longer line units of its own, whatever stands around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import bytewords as bw
from rankloom.llm.tables import pick, row_key, store

KEY = ["doc_id", "key_a", "key_b"]
_PLACES = [p | 1 for p in (0x9E6C63D0876A9A99, 0xC2B2AE3D27D4EB4F)]


@dataclass(frozen=True)
class SubstringDedup:
    """``least_words``: shorter units are no passages and always stay. In scripts without blanks two characters count as a word."""

    least_words: int = 6


#: Sentence ends and other marks of full width, and letters of scripts that are written without blanks (Thai to
#: Tibetan, Burmese, Khmer, kana, Chinese characters); first and last code points.
_WIDE_ENDS = (0x3002, 0xFF01, 0xFF0E, 0xFF1F, 0xFF61)
_WIDE_MARKS = ((0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF5F, 0xFF65))
_UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _wide(block: bw.TextBlock) -> tuple[bw.TextBlock, np.ndarray, np.ndarray]:
    """The block with marks of full width as separators, the last bytes of sentence ends among them, and the first bytes of
    letters of scripts without blanks."""
    data = block.data
    lead = np.flatnonzero(data >= 0xE0)
    if not lead.size:
        return block, lead, lead
    low = lambda i: data[lead + i].astype(np.int64) & 0x3F
    code = ((data[lead].astype(np.int64) & 0x0F) << 12) | (low(1) << 6) | low(2)
    # Four bytes: the first three give all but the last six bits.
    code = np.where(data[lead] >= 0xF0, (((data[lead].astype(np.int64) & 0x07) << 12) | (low(1) << 6) | low(2)) << 6, code)
    within = lambda spans: np.logical_or.reduce([(code >= a) & (code <= b) for a, b in spans])
    marks = lead[within(_WIDE_MARKS)]
    if marks.size:
        data = data.copy()
        for i in range(3):
            data[marks + i] = 0x01
    return bw.TextBlock(block.first, data, block.offsets), lead[np.isin(code, _WIDE_ENDS)] + 2, lead[within(_UNSPACED)]


def _cuts(block: bw.TextBlock) -> np.ndarray:
    """True at the bytes that part units: a line feed, or a blank after a full stop, exclamation or question mark."""
    data = block.data
    cut = data == 0x0A
    after = np.zeros(data.size, dtype=bool)
    after[1:] = np.isin(data[:-1], (0x2E, 0x21, 0x3F))
    cut |= after & ((data == 0x20) | (data == 0x09))
    return cut


def _unit_digests(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    place = np.arange(hashes.size) - np.repeat(first, size)
    out = []
    for step in _PLACES:
        factors = np.full(int(size.max(initial=0)) + 1, step, dtype=np.uint64)
        powers = np.cumprod(factors, dtype=np.uint64)
        total = np.add.reduceat(hashes * powers[place], first, dtype=np.uint64) if first.size else np.zeros(0, np.uint64)
        out.append(bw.mix(total + size.astype(np.uint64)).view(np.int64))
    return out


def units(documents: DataFrame, how: SubstringDedup) -> DataFrame:
    """One row per unit of ``least_words`` words or more, or of twice as many letters of scripts without blanks (its digest and character span), and one row per text with its
    number of such units (``start`` null)."""
    schema = "doc_id long, key_a long, key_b long, n_units long, start long, stop long, d1 long, d2 long"

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch.column("text")):
                plain, ends, unspaced = _wide(block)
                words = bw.find_words(plain, bw.ALNUM)
                cut = _cuts(block)
                cut[ends] = True
                part = np.cumsum(cut)
                of_word = part[words.starts]
                new = np.ones(words.starts.size, dtype=bool)
                new[1:] = (of_word[1:] != of_word[:-1]) | (words.row[1:] != words.row[:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, words.starts.size))
                digests = _unit_digests(bw.word_hashes(words), first, size)
                row = words.row[first]
                # A unit ends before the next cut or with its text.
                where = np.append(np.flatnonzero(cut), block.data.size)
                stop = np.minimum(where[of_word[first]], block.offsets[row + 1])
                chars = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
                begin = chars[block.offsets[row]]
                of_unit = np.cumsum(new) - 1
                letters = np.bincount(of_unit[np.searchsorted(words.starts, unspaced, side="right") - 1], minlength=first.size)
                long = (size >= how.least_words) | (letters >= 2 * how.least_words)
                count = np.bincount(row[long], minlength=block.rows)
                rows = np.concatenate((np.arange(block.rows), row[long]))
                none = np.arange(rows.size) < block.rows
                pad = np.zeros(block.rows, dtype=np.int64)
                column = lambda x: pa.array(np.concatenate((pad, x[long])), mask=none)
                here = batch.slice(block.first, block.rows).select(KEY).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *here.columns,
                        pa.array(np.concatenate((count, np.zeros(rows.size - block.rows, np.int64)))),
                        column(chars[words.starts[first]] - begin),
                        column(chars[stop] - begin),
                        column(digests[0]),
                        column(digests[1]),
                    ],
                    names=[*KEY, "n_units", "start", "stop", "d1", "d2"],
                )

    docs = pick(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.select("doc_id", *row_key(F.col("text")), "text").mapInArrow(per_batch, schema)


def repeated_spans(documents: DataFrame, how: SubstringDedup = SubstringDedup()) -> DataFrame:
    """One row per (doc_id, text): doc_id, key_a, key_b, n_units, and ``removed``: the sorted (start, stop) to take out.

    The earliest occurrence by (doc_id, digest of the text, place) stays, wherever the others are, also in the same text;
    null ids rank first. Spans are character offsets in the original text. A null text has no units. Rows that repeat a
    doc_id and its text count as one. An empty table gives no rows; further columns are ignored.
    """
    all_units = store(units(documents, how))
    place = F.struct(*KEY, "start")
    found = all_units.filter("start is not null")
    many = found.groupBy("d1", "d2").agg(F.min(place).alias("keep"), F.max(place).alias("last")).filter("keep != last")
    again = found.join(many.select("d1", "d2", "keep"), ["d1", "d2"]).filter(place != F.col("keep"))
    span = F.struct("start", "stop")
    rows = all_units.filter("start is null").select(*KEY, "n_units", F.lit(None).cast("struct<start: long, stop: long>").alias("span"))
    rows = rows.union(again.select(*KEY, F.lit(0).cast("long"), span))
    return rows.groupBy(*KEY).agg(F.max("n_units").alias("n_units"), F.array_sort(F.collect_set("span")).alias("removed"))


def without_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, kept): each text without its ``removed`` spans, and the offsets of the pieces that stayed."""

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            texts, kept = [], []
            for text, removed in zip(frame["text"], frame["removed"], strict=True):
                text, at, pieces = text or "", 0, []
                for span in removed:
                    pieces.append((at, span["start"]))
                    at = span["stop"]
                pieces = [(a, b) for a, b in (*pieces, (at, len(text))) if a < b]
                texts.append("".join(text[a:b] for a, b in pieces))
                kept.append([{"start": a, "stop": b} for a, b in pieces])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts, "kept": kept})

    docs = pick(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text", *row_key(F.col("text")))
    same = [docs[c].eqNullSafe(spans[c]) for c in KEY]
    joined = docs.join(spans, same).select(docs["doc_id"], "text", "removed")
    return joined.mapInPandas(cut, "doc_id long, text string, kept array<struct<start: long, stop: long>>")
