"""Texts cut before runs of spaces, each distinct part handled once.

Where no piece of a vocabulary crosses such a cut, a text's encoding is the encodings of
its parts in a row. Parts repeat far more than texts, so what is costly is done once per
distinct part of a piece of the column, and remembered for later ones up to a number.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trackweave.llm.piece_model import SPACE_MARK
from trackweave.llm.words import IDENTITY, Words, cut, mix, pieces

SPACE_ONLY = np.zeros(256, dtype=bool)
SPACE_ONLY[0x20] = True
MOST_KNOWN = 400_000  # distinct parts remembered by one worker process
PIECE = 1 << 22


@dataclass
class Parts:
    """Parts of consecutive texts in order; a text's parts are ``first[i]:first[i + 1]``."""

    words: Words
    key: np.ndarray  # equal for equal parts
    lead: np.ndarray  # spaces before the part, the text's own leading one included
    word: np.ndarray  # its word, or -1 for spaces at the end of a text
    first: np.ndarray

    def texts(self, which: np.ndarray, mark: str = " ") -> list[str]:
        """The parts of the given numbers, with ``mark`` for each space."""
        data, words = self.words.data.tobytes(), self.words
        word = self.word[which]
        inside = np.maximum(word, 0)
        begin = words.begin[inside] if len(words) else np.zeros(len(which), np.int64)
        end = np.where(word < 0, begin, words.end[inside] if len(words) else 0)
        lead = {n: mark * n for n in np.unique(self.lead[which]).tolist()}
        rows = zip(self.lead[which].tolist(), begin.tolist(), end.tolist())
        return [lead[n] + data[a:b].decode() for n, a, b in rows]


def parts_of(data: np.ndarray, texts: np.ndarray, prefix: int) -> Parts:
    """``prefix`` spaces are put before every text that is not empty."""
    words = cut(data, texts, SPACE_ONLY)
    counts, n = words.counts(), len(texts) - 1
    last = np.where(counts > 0, words.end[np.maximum(words.first[1:] - 1, 0)] if len(words) else 0, texts[:-1])
    tail = texts[1:] - last  # spaces at the end
    first = np.concatenate([[0], np.cumsum(counts + (tail > 0))])
    total = int(first[-1])
    word = np.full(total, -1, dtype=np.int64)
    lead = np.zeros(total, dtype=np.int64)
    at = np.arange(len(words)) + np.repeat(first[:-1] - words.first[:-1], counts)
    word[at] = np.arange(len(words))
    before = np.empty(len(words), dtype=np.int64)
    before[1:] = words.end[:-1]
    starts = words.first[:-1][counts > 0]
    before[starts] = texts[:-1][counts > 0]
    lead[at] = words.begin - before
    lead[first[1:][tail > 0] - 1] = tail[tail > 0]
    lead[first[:-1][np.diff(first) > 0]] += prefix
    key = np.zeros(total, dtype=np.uint64)
    key[at] = words.hashes(IDENTITY)
    key = mix(key + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Parts(words, key, lead, word, first)


def column_parts(column: pa.Array, prefix: int = 1, mark: str = " ", limit: int = PIECE // 4) -> Iterator[tuple[int, Parts]]:
    """``(first row, parts)`` of runs of rows of at most ``limit`` bytes; a longer text is a run of its own."""
    # a mark written in a text is a space to the model; a run of both must not be cut
    column = pc.replace_substring(column, mark, " ")
    for row, data, texts in pieces(column, limit):
        yield row, parts_of(data, texts, prefix)


def parted(
    column: pa.Array, make: Callable[[list[str]], list], prefix: int = 1, mark: str = " "
) -> Iterator[tuple[int, Parts, np.ndarray, list]]:
    """``(first row, parts, number of each part, results)``: ``make`` is given each distinct part once."""
    known: dict[int, object] = {}
    # a mark written in a text is a space to the model; a run of both must not be cut
    column = pc.replace_substring(column, SPACE_MARK, " ")
    for row, data, texts in pieces(column, PIECE):
        parts = parts_of(data, texts, prefix)
        keys, at, number = np.unique(parts.key, return_index=True, return_inverse=True)
        if len(known) > MOST_KNOWN:
            known.clear()
        wanted = keys.tolist()
        new = [i for i, k in enumerate(wanted) if k not in known]
        gc.disable()  # many small results, none of them in a cycle
        try:
            for i, value in zip(new, make(parts.texts(at[new], mark))):
                known[wanted[i]] = value
        finally:
            gc.enable()
        yield row, parts, number, [known[k] for k in wanted]
