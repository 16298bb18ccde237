"""What each of five text filters removes, in every order they can be applied.

The filters do not change texts, so a document survives a set of filters exactly when it
fails none of them. Its five failures make one 32-bit word: bit ``s`` tells whether it
survives the set ``s`` (a number of five bits, the lowest for ``A``). The words of a part
of the corpus are added up position by position with carry-save adders: three words of one
weight give a word of that weight and a word of twice that weight, so a bit of the sum costs a
few whole-array operations and no loop over documents or sets. A task gives 32 counts for
each part and label; their sums answer every question about orders, without a second
look at the documents.

A document fails
``A`` with under 200 words; ``B`` if fewer than half of its words are distinct;
``C`` with over 3 % of ``A``-``Z`` among its characters; ``D`` if it holds one of ``#$%&*|``;
``E`` if a document of smaller id has the same text. Words are maximal runs of characters other
than ``0x20`` and ``0x09``-``0x0D``, as written.

Null text is empty text: it fails ``A``, and ``E`` if a smaller id has null or empty text.
A null part is the part ``""``. Texts of any length are read whole, long ones in pieces. Equal
texts are found by a 128-bit digest. Of a repeated id all rows count, and rows of the same id
do not fail ``E`` by each other; neither does a row without id, nor by one.
A document is good or toxic if any of its label rows says 1; label rows without id count for
nothing. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.llm import words

FILTERS = "ABCDE"
LEAST_WORDS = 200
SETS = 1 << len(FILTERS)
#: the survival word of each pattern of failures
SURVIVAL = np.array([sum(1 << s for s in range(SETS) if not s & f) for f in range(SETS)], dtype=np.uint32)

LONG = 1 << 22
#: parts whose counts a task holds before it hands them on
MOST_HELD = 4096

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that continue a character
_SIGNS = re.compile(rb"[#$%&*|]")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _lots(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of a long one a piece at a time."""
    if len(text) <= LONG:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = _BLANK.search(text, min(at + LONG, len(text)))
        stop = end.start() if end else len(text)
        yield text[at:stop].split()
        at = stop + 1


def failures(text: bytes) -> int:
    """Which of ``A`` to ``D`` a text fails, as bits."""
    n, seen = 0, set()
    for lot in _lots(text):
        n += len(lot)
        seen.update(lot)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    chars = len(text.translate(None, _INSIDE))
    fails = (n < LEAST_WORDS, 100 * len(seen) < 50 * n, 100 * capitals > 3 * chars, _SIGNS.search(text) is not None)
    return sum(1 << i for i, f in enumerate(fails) if f)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in words.pieces(batch.column("text")):
            fails, digests = [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                text = data[a:b].tobytes()
                fails.append(failures(text))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            part = batch.slice(row, len(fails))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "fails", "digest"],
            )


def described(docs: DataFrame, part: Column) -> DataFrame:
    """``(doc_id, part, fails, digest)``: what each text fails by itself."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(_describe, "doc_id long, part string, fails int, digest binary")


def _flags(labels: DataFrame) -> DataFrame:
    """``(doc_id, good, toxic)``, one row of each labelled id."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return known.agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )


def failed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, good, toxic, fails)`` of each document, with ``E`` among the failures.

    The smallest id of each text is found first (combined before the shuffle, so a text with
    any number of copies is no hot group) and then met by id and not by text.
    ``rows`` is read twice, so it should come from a written table.
    """
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.groupBy("doc_id").agg(F.collect_set("digest").alias("own"))
    again = ~F.coalesce(F.array_contains("own", F.col("digest")), F.lit(False))
    flag = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    met = known.join(first, "doc_id", "left").join(_flags(labels), "doc_id", "left")
    met = met.select("part", *flag, F.col("fails").bitwiseOR(F.when(again, 16).otherwise(0)).alias("fails"))
    return met.unionByName(rows.where("doc_id IS NULL").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "fails"))


def positional_counts(survivals: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by layers of carry-save adders."""
    counts = np.zeros(SETS, dtype=np.int64)
    weight, level = 1, survivals
    while len(level):
        carried = []
        while len(level) >= 3:
            n = len(level) // 3
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            level = np.concatenate([odd ^ c, level[3 * n :]])
        for word in level:
            counts += weight * ((int(word) >> np.arange(SETS)) & 1)
        level = np.concatenate(carried) if carried else level[:0]
        weight *= 2
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}

    def given() -> pa.RecordBatch:
        parts, good, toxic = zip(*held)
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(parts, dtype=object), SETS), pa.string()),
                pa.array(np.repeat(np.array(good), SETS)),
                pa.array(np.repeat(np.array(toxic), SETS)),
                pa.array(np.tile(np.arange(SETS, dtype=np.int32), n)),
                pa.array(np.concatenate(list(held.values()))),
            ],
            names=["part", "good", "toxic", "subset", "n"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").dictionary_encode()
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
        kind = parts.indices.to_numpy() * 4 + good * 2 + toxic
        survivals = SURVIVAL[batch.column("fails").to_numpy()]
        order = np.argsort(kind, kind="stable")
        kinds, starts = np.unique(kind[order], return_index=True)
        for k, some in zip(kinds.tolist(), np.split(survivals[order], starts[1:])):
            key = (parts.dictionary[k // 4].as_py(), bool(k & 2), bool(k & 1))
            held[key] = held.get(key, 0) + positional_counts(some)
        if len(held) > MOST_HELD:
            yield given()
            held.clear()
    if held:
        yield given()


def survivors(marked: DataFrame) -> DataFrame:
    """``(part, sets)``: for each set of filters, in order, how many documents, good and toxic ones survive it."""
    counted = marked.mapInArrow(_count, "part string, good boolean, toxic boolean, subset int, n long")
    by_set = counted.groupBy("part", "subset").agg(
        F.sum("n").alias("docs"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0).cast("long")).alias("good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0).cast("long")).alias("toxic"),
    )
    return by_set.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "docs", "good", "toxic"))).alias("sets"))


def orders(survived: DataFrame) -> DataFrame:
    """The report of every order and step, from the survivors of every set."""
    every = ["".join(p) for p in permutations(FILTERS)]
    rows = survived.select("part", "sets", F.explode(F.lit(every)).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    before = sum(F.when(F.instr("filter_order", f) < F.col("step"), b).otherwise(0) for f, b in bit.items())
    own = sum(F.when(F.instr("filter_order", f) == F.col("step"), b).otherwise(0) for f, b in bit.items())
    rows = rows.select("*", before.alias("before"), own.alias("own"))

    def left(subset: Column, of: str) -> Column:
        return F.element_at("sets", (subset + 1).cast("int"))[of]

    def lost(subset: Column, of: str) -> Column:
        return left(subset, of) - left(subset + F.col("own"), of)

    none, rest, earlier = F.lit(0), F.lit(SETS - 1) - F.col("own"), F.col("before")
    report = rows.select(
        "part",
        "filter_order",
        "step",
        "own",
        left(earlier + F.col("own"), "docs").alias("kept"),
        lost(earlier, "docs").alias("removed"),
        (lost(none, "docs") - lost(earlier, "docs")).alias("redundant"),
        lost(rest, "docs").alias("unique_fails"),
        lost(earlier, "good").alias("good_lost"),
        lost(earlier, "toxic").alias("toxic_lost"),
    )
    return report.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
