"""Words of whole Arrow columns of texts, cut and hashed without a Python loop per word.

A word is a maximal run of bytes other than ``0x20`` and ``0x09``-``0x0D``, with
``A``-``Z`` lower-cased. Bytes of longer UTF-8 characters never equal these, so
working on bytes gives the same words as working on characters.

Texts are handled in pieces of at most ``PIECE`` bytes (a longer text is a piece of
its own), so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd factors."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_FACTORS = odd_numbers(256, 1)


def _factors(n: int) -> np.ndarray:
    """Factor of each byte position in a word; long words need more of them."""
    global _FACTORS
    if n > len(_FACTORS):
        if n > 1 << 16:
            return odd_numbers(n, 1)
        _FACTORS = odd_numbers(1 << max(8, (n - 1).bit_length()), 1)
    return _FACTORS


@dataclass
class Words:
    """Words of consecutive texts: ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray  # all bytes of the texts
    begin: np.ndarray  # byte offsets of the words
    end: np.ndarray
    first: np.ndarray
    texts: np.ndarray  # byte offsets of the texts, one more than texts

    def __len__(self) -> int:
        return len(self.begin)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, fold: np.ndarray = LOWER) -> np.ndarray:
        """A 64-bit hash of each word, with its bytes taken through ``fold``."""
        if not len(self.begin):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.begin
        at = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        value = fold[self.data[inside + np.repeat(self.begin, size)]].astype(np.uint64)
        value += np.uint64(1)
        value *= _factors(int(size.max()))[inside]
        return mix(np.add.reduceat(value, at))

    def bytes(self, i: int) -> bytes:
        return LOWER[self.data[self.begin[i] : self.end[i]]].tobytes()


def cut(data: np.ndarray, texts: np.ndarray, apart: np.ndarray = SPACE) -> Words:
    """Words of the texts between the offsets ``texts``; ``apart`` marks bytes between words."""
    n = len(data)
    solid = np.zeros(n + 1, dtype=bool)
    solid[:n] = ~apart[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = solid[:-1]
    begin = np.flatnonzero(solid & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~solid))
    return Words(data, begin, end, np.searchsorted(begin, texts), texts)


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows of at most ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, Words]]:
    for row, data, offsets in pieces(column, limit):
        yield row, cut(data, offsets)


_GRAM = odd_numbers(64, 2)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: hashes of all runs of ``size`` words in text order.

    ``first[i]:first[i + 1]`` are those of text ``i``. A text with fewer words gives
    one hash of its whole sequence, a text without words none.
    """
    h = words.hashes()
    counts = words.counts()
    grams = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(grams)])
    total = int(first[-1])
    out = np.zeros(total, dtype=np.uint64)
    if total:
        row = np.repeat(np.arange(len(counts)), grams)
        start = np.arange(total) - first[row] + words.first[row]
        have = np.minimum(counts, size)[row]
        for j in range(size):
            there = have > j
            if there.all():
                out += h[start + j] * _GRAM[j]
            else:
                out[there] += h[start[there] + j] * _GRAM[j]
        out += have.astype(np.uint64) * _GRAM[63]
        out = mix(out)
    return out, first
