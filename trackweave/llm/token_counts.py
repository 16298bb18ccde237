"""Number of unigram tokens of whole texts, with shared prefixes scored once.

A text is cut before runs of spaces, which no piece of the vocabulary crosses. The distinct
parts are inserted in a trie, which is walked in sorted order: the forward scores of the
current path are held, so a prefix that parts share is scored once, and each part's count
is stored where it ends. A text's count is the sum over its parts.

The best segmentation has the highest sum of piece scores and, among those, the fewest
pieces. A character without a piece of its own costs the lowest score less 10 and counts
as its UTF-8 bytes if the model falls back to bytes, else as one token.

Defined cases: null text has a null count, empty text 0. Other columns pass through,
columns named ``n_tokens`` or ``n_parts`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from trackweave.llm.piece_model import NORMAL, SPACE_MARK, TOKENIZER, USER_DEFINED, PieceModel, model_bytes, parse
from trackweave.llm.segments import parted

MOST_BYTES = 64 << 20
UNKNOWN_COST = 10.0
_SCORE = ""  # key of a piece's score in the backward tree


class Counter:
    """Counts pieces of parts; ``pieces`` in a tree from their last character backward."""

    def __init__(self, model: PieceModel):
        self.tree: dict = {}
        usable = [(p, s) for p, s, k in zip(model.pieces, model.scores, model.kinds) if k in (NORMAL, USER_DEFINED) and p]
        for piece, score in usable:
            node = self.tree
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[_SCORE] = max(score, node.get(_SCORE, score))
        self.single = {p for p, _ in usable if len(p) == 1}
        self.unknown = min((s for _, s in usable), default=0.0) - UNKNOWN_COST
        self.byte_fallback = model.byte_fallback
        self.prefix = int(model.add_dummy_prefix)

    def counts(self, parts: list[str]) -> list[int]:
        """Tokens of each part, in the order given."""
        order = sorted(range(len(parts)), key=parts.__getitem__)
        out = [0] * len(parts)
        path, score, count = "", [0.0], [0]
        tree, single = self.tree, self.single
        for k in order:
            part = parts[k]
            at, most = 0, min(len(path), len(part))
            while at < most and path[at] == part[at]:
                at += 1
            del score[at + 1 :], count[at + 1 :]
            for end in range(at, len(part)):
                best, fewest, node, start = -1e300, 0, tree, end
                while start >= 0:
                    node = node.get(part[start])
                    if node is None:
                        break
                    piece = node.get(_SCORE)
                    if piece is not None:
                        total = score[start] + piece
                        if total > best or total == best and count[start] + 1 < fewest:
                            best, fewest = total, count[start] + 1
                    start -= 1
                if part[end] not in single:
                    total, more = score[end] + self.unknown, len(part[end].encode()) if self.byte_fallback else 1
                    if total > best or total == best and count[end] + more < fewest:
                        best, fewest = total, count[end] + more
                score.append(best)
                count.append(fewest)
            path = part
            out[k] = count[len(part)]
        return out


@lru_cache(maxsize=2)
def counter(data: bytes) -> Counter:
    model = parse(data)
    if model.charsmap or model.remove_extra_whitespaces or not model.cuts_at_spaces():
        raise ValueError("the model rewrites texts or has pieces across spaces")
    return Counter(model)


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens`` and ``n_parts`` of ``text``."""
    data = model_bytes(docs.sparkSession, path)
    if len(data) > MOST_BYTES:
        raise ValueError("the model file is too large to be sent to the tasks")
    counter(data)
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sent.value)
        for batch in batches:
            column = batch.column("text")
            for row, parts, number, made in parted(column, count.counts, count.prefix, SPACE_MARK):
                n = len(parts.first) - 1
                sums = np.concatenate([[0], np.cumsum(np.array(made, dtype=np.int64)[number])])[parts.first]
                null = column.slice(row, n).is_null().to_numpy(zero_copy_only=False)
                kept = batch.slice(row, n)
                extra = [pa.array(np.diff(sums), pa.int64(), mask=null), pa.array(np.diff(parts.first), pa.int64(), mask=null)]
                yield pa.RecordBatch.from_arrays([*[kept.column(i) for i in range(kept.num_columns)], *extra], names=[*kept.schema.names, "n_tokens", "n_parts"])

    rows = docs.drop("n_tokens", "n_parts")
    schema = StructType([*rows.schema.fields, StructField("n_tokens", LongType()), StructField("n_parts", LongType())])
    return rows.mapInArrow(run, schema)
