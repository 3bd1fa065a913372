"""Words of many texts at once, as positions in their UTF-8 bytes, and hashes of words and of runs of words.

Everything here works on one block of texts (``TextBlock``) with whole-array operations; no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the given closed ranges."""
    chosen = np.zeros(256, dtype=bool)
    for low, high in ranges:
        chosen[low : high + 1] = True
    return chosen


SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words of everything but white space, as bytes.
NON_SPACE = ~SPACES
#: Words of ASCII letters, digits and everything beyond ASCII, after lower-casing.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; those of one usual block are kept."""
    kept = _POWERS[0].size
    if n <= kept:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, 2 * BLOCK_BYTES)
    made = []
    for step in (_STEP, _STEP_BACK):
        factors = np.full(size, step, dtype=np.uint64)
        factors[0] = 1
        made.append(np.cumprod(factors, dtype=np.uint64))
    if size <= 4 * BLOCK_BYTES:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


@dataclass
class TextBlock:
    """Some rows of a batch: ``first`` is the row of the batch that the block starts with."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.offsets.size - 1


@dataclass
class Words:
    """Start and end byte of every word, the row of the block it is in, and the words of each row."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    counts: np.ndarray
    codes: np.ndarray

    @property
    def first_of_row(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """The texts in blocks of about ``limit`` bytes; null is read as empty, a longer text is a block of its own."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, where, body = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield TextBlock(row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def find_words(block: TextBlock, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes ``inside`` (a ``byte_set``) after A-Z became a-z; a run ends with its text."""
    low = LOWER[block.data]
    word = inside[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    edge = block.offsets[1:-1]
    inner = edge[(edge > 0) & (edge < low.size)]
    begins[inner] |= word[inner]
    stops[inner - 1] |= word[inner - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    row = np.searchsorted(block.offsets, starts, "right") - 1
    return Words(starts, ends, row, np.bincount(row, minlength=block.rows), low)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of every word: a polynomial over the block, taken back to each word's start."""
    up, back = _powers(words.codes.size + 1)
    total = np.zeros(words.codes.size + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[words.codes] * up[:-1], dtype=np.uint64, out=total[1:])
    return mix((total[words.ends] - total[words.starts]) * back[words.starts] + (words.ends - words.starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words inside one text, and the number of the run's first word."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = hashes[:n] * _PLACE[0]
    for i in range(1, k):
        total = total + hashes[i : i + n] * _PLACE[i]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(total[at] + np.uint64(k)), at


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """One hash of a short sequence of words, as ``gram_hashes`` would give for its length."""
    total = (hashes * _PLACE[: hashes.size]).sum(dtype=np.uint64) + np.uint64(hashes.size)
    return mix(np.array([total], dtype=np.uint64))[0]
