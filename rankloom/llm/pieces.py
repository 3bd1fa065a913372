"""SentencePiece encoding and decoding of whole columns by a shared-prefix forward pass.

The marked words of a batch are made distinct, sorted and walked depth-first as a trie: a word keeps the forward states of
the prefix it shares with the word before it and only goes on from there. For a unigram model a state is the best score and
the piece that reaches it (Viterbi). For a BPE model, whose result is not the segmentation with the best sum of scores, a
state is the last piece of the encoding of that prefix: the piece that fits there and that BPE keeps apart from the piece
before it. The two differ only in how a state is chosen.

For BPE a word ends wherever two letters meet that stand side by side in no piece: no merge crosses such a place, so what is
before and after it is encoded on its own, and words that differ in a comma at the end share all else.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rankloom.llm.tables import pick, row_key

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NEVER = -np.inf
UNIGRAM, BPE = 1, 2
BATCH_CHARS = 1_000_000
KEPT_WORDS = 500_000


@dataclass(frozen=True)
class PieceModel:
    """What is read from a model file: pieces, scores, which ids are ordinary pieces, and the model type."""

    kind: int
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ordinary: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    dummy_prefix: bool


def read_model(path: str) -> PieceModel:
    """Read a model with identity normalisation and byte fallback or an unknown piece."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(processor.serialized_model_proto())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models without text normalisation are supported")
    pieces = tuple(p.piece for p in proto.pieces)
    where = {p: i for i, p in enumerate(pieces)}
    bytes_of = tuple(where.get(f"<0x{b:02X}>", -1) for b in range(256))
    return PieceModel(
        proto.trainer_spec.model_type,
        pieces,
        tuple(p.score for p in proto.pieces),
        tuple(p.type == 1 for p in proto.pieces),
        bytes_of if min(bytes_of) >= 0 else (),
        processor.unk_id(),
        spec.add_dummy_prefix,
    )


def _pairs(text: str) -> np.ndarray:
    """A digest of 20 bits of each two neighbours of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(12)


class Encoder:
    """Encodes sorted marked words with the states of shared prefixes."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = {p: i for i, (p, plain) in enumerate(zip(model.pieces, model.ordinary, strict=True)) if plain}
        self.longest = max(map(len, self.ids))
        self.stay = lru_cache(1 << 16)(self._stay)
        # Lengths of the pieces that end with given letters, up to four: few lengths are tried at each place.
        by_end: dict[str, set[int]] = {}
        for piece in self.ids:
            by_end.setdefault(piece[-4:], {1}).add(len(piece))
        for end, found in by_end.items():
            found.update(n for n in range(2, len(end)) if end[-n:] in self.ids)
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in by_end.items()}
        # Whether some piece holds two neighbours, by a digest of the two: pairs that share one only cause fewer cuts.
        self.inside = np.zeros(1 << 20, dtype=bool)
        self.inside[_pairs("".join({p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}))[::2]] = True
        self.score = {p: model.scores[i] for p, i in self.ids.items()}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.worst = min(model.scores) - 10.0

    def split(self, text: str) -> list[str]:
        """The words of a marked text. Without byte pieces only marks end them: unknown letters in a row are one piece."""
        if self.model.kind != BPE or not self.model.byte_ids:
            return _WORD.findall(text)
        at = (np.flatnonzero(~self.inside[_pairs(text)]) + 1).tolist()
        return [text[a:b] for a, b in pairwise([0, *at, len(text)])] if text else []

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The BPE pieces of a short text by its definition: the best-scored neighbours first, the left ones on ties.

        Ends early when ``least`` parts are left."""
        parts = list(text)
        scores, ids = self.model.scores, self.ids
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """What stands at the left and at the right end of a piece while it is merged, each with the score at which it is merged
        away, from the single letter to the piece. None where merges do not run from better to worse scores, or do not lead to it."""
        if piece not in self.edges:
            self.edges[piece] = self._find_edges(piece)
        return self.edges[piece]

    def _find_edges(self, piece: str) -> tuple[list, list] | None:
        last = (piece, NEVER)
        if len(piece) == 1:
            return [last], [last]
        parts = self.merged(piece, 2)
        if len(parts) > 2 or piece not in self.score:
            return None
        (a, b), gone = parts, self.score[piece]
        left, right = self._edges(a), self._edges(b)
        if left is None or right is None or any(len(x) > 1 and self.score[x] <= gone for x in parts):
            return None
        return [*left[0][:-1], (a, gone), last], [*right[1][:-1], (b, gone), last]

    def _stay(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def together(self, left: str, right: str) -> bool:
        """Whether BPE leaves the two pieces as they are when they stand side by side.

        Merges within either run from better to worse scores, so only the pieces at the border matter: the two are joined if a
        merge across it is better than the one that takes its left side away, and no worse than the one of its right side.
        """
        of_left, of_right = self._edges(left), self._edges(right)
        if of_left is None or of_right is None:
            return self.stay(left, right)
        ends, starts, score = iter(of_left[1]), iter(of_right[0]), self.score
        (a, gone_a), (b, gone_b) = next(ends), next(starts)
        while True:
            across = score.get(a + b)
            if across is not None and across > gone_a and across >= gone_b:
                return False
            if gone_a < gone_b:
                b, gone_b = next(starts)
            elif gone_a > NEVER:
                a, gone_a = next(ends)
            else:
                return True

    def words(self, sorted_words: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each word; the words come sorted, so a common prefix is walked once."""
        forward = self._forward_bpe if self.model.kind == BPE else self._forward_best
        past, states = "", [("", 0.0)]
        for word in sorted_words:
            shared, most = 0, min(len(past), len(word))
            while shared < most and past[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(forward(word, end, states))
            past = word
            yield self._ids(self._pieces(word, states))

    def _forward_bpe(self, word: str, end: int, states: list) -> tuple[str | None, float]:
        ids, lengths = self.ids, self.lengths
        near = word[max(0, end - 4) : end]
        for size in lengths.get(near) or lengths.get(near[-3:]) or lengths.get(near[-2:], (1,)):
            if size > end:
                continue
            piece = word[end - size : end]
            if size > 1 and piece not in ids:
                continue
            before = states[end - size][0]
            if self.together(before, piece) if before else before is not None and self._whole(piece):
                return piece, 0.0
        return None, 0.0

    def _whole(self, piece: str) -> bool:
        return len(piece) == 1 or self._edges(piece) is not None or self.merged(piece) == [piece]

    def _forward_best(self, word: str, end: int, states: list) -> tuple[str, float]:
        best, found = -np.inf, word[end - 1 : end]
        for size in range(1, min(end, self.longest) + 1):
            piece = word[end - size : end]
            known = self.ids.get(piece)
            if known is None and size > 1:
                continue
            score = states[end - size][1] + (self.model.scores[known] if known is not None else self.worst)
            if score > best:
                best, found = score, piece
        return found, float(best)

    def _pieces(self, word: str, states: list) -> list[str]:
        """Walk back from the end; a word whose states do not lead there is merged directly."""
        out, end = [], len(word)
        while end:
            piece = states[end][0]
            if not piece:
                return self.merged(word)
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def _ids(self, parts: list[str]) -> list[int]:
        out = list(map(self.ids.get, parts))
        if None not in out:
            return out
        out = []
        for part in parts:
            found = self.ids.get(part)
            if found is not None:
                out.append(found)
            elif self.model.byte_ids:
                out += [self.model.byte_ids[b] for b in part.encode()]
            elif not out or out[-1] != self.model.unknown:
                out.append(self.model.unknown)
        return out


def marked(text: str, model: PieceModel) -> str:
    """The text with marks for blanks and the mark in front that the model adds."""
    return (MARK if model.dummy_prefix and text else "") + text.replace(" ", MARK)


def decode(ids: Sequence[int], model: PieceModel) -> str:
    """The text of a row of ids: pieces joined, runs of byte pieces read as UTF-8, marks as blanks."""
    value = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
    raw = b"".join(value[i] if i in value else model.pieces[i].encode() for i in ids)
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def _parts(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``BATCH_CHARS`` bytes or ids: the first and the one after the last."""
    first, size = 0, 0
    for i, more in enumerate(sizes):
        size += more
        if size >= BATCH_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encode_texts(texts: list[str], encoder: Encoder, kept: dict[str, bytes]) -> list[np.ndarray]:
    """The ids of every text. ``kept`` holds words of earlier batches; it is emptied when it has grown too large."""
    split = [encoder.split(marked(t, encoder.model)) for t in texts]
    words = set(chain.from_iterable(split))
    fresh = sorted(words.difference(kept))
    if len(kept) + len(fresh) > KEPT_WORDS:
        kept.clear()
        fresh = sorted(words)
    kept.update(zip(fresh, (array("i", x).tobytes() for x in encoder.words(fresh)), strict=True))
    return [np.frombuffer(b"".join(map(kept.__getitem__, words)), dtype=np.int32) for words in split]


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, key_a, key_b, ``ids`` (the pieces of the whole text).

    A null or empty text has no ids. Repeated rows each give a row; ids may be null; an empty table gives no rows; further
    columns are ignored. The model is read by the driver and sent with the job (its size is that of the vocabulary).
    """
    model = read_model(model_path)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kept = Encoder(model), {}
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for first, stop in _parts(pc.binary_length(texts).to_pylist()):
                ids = encode_texts(texts[first:stop].to_pylist(), encoder, kept)
                where = np.concatenate(([0], np.cumsum([x.size for x in ids]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(where), pa.array(np.concatenate(ids)))
                here = batch.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays(
                    [here.column("doc_id"), here.column("key_a"), here.column("key_b"), column],
                    names=["doc_id", "key_a", "key_b", "ids"],
                )

    docs = pick(documents, doc_id="doc_id", text="text")
    docs = docs.select(F.col("doc_id").cast("long"), *row_key(F.col("text")), "text")
    return docs.mapInArrow(per_batch, "doc_id long, key_a long, key_b long, ids array<int>")


def _decoded(ids: pa.ListArray, said: pa.BinaryArray, dummy_prefix: bool) -> pa.Array:
    """The texts of lists of ids, as ``decode`` has them, by joins of whole columns; null for null."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), said.take(ids.flatten()))
    raw = pc.binary_join(pieces, b"")
    try:
        text = raw.cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
    text = pc.replace_substring(text, MARK, " ")
    if dummy_prefix:
        text = pc.replace_substring_regex(text, r"\A ", "", max_replacements=1)
    return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (with ``ids``) with the column ``decoded``, the text that the ids stand for; null ids give null."""
    model = read_model(model_path)
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
        said = pa.array([values.get(i, p.encode()) for i, p in enumerate(model.pieces)], pa.binary())
        for batch in batches:
            for first, stop in _parts(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()):
                here = batch.slice(first, stop - first)
                texts = _decoded(here.column("ids"), said, model.dummy_prefix)
                yield pa.RecordBatch.from_arrays([*here.columns, texts], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(per_batch, schema)
