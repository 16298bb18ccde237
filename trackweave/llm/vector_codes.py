"""Codes of vectors: one of a codebook's entries for each of four consecutive parts.

The codebooks come from rounds of Lloyd's method in whole numbers, exact at any size. The
parts of the vectors live where their entry is: rows are dealt by (position, entry, salt) once,
and a task that holds them is their owner. In a round

1. every owner adds up its resident members of each entry; the few sums of all owners make the
   new codebooks (only sums, entries and counts of entries reach the driver, bounded by the
   size of the codebooks and not by the data);
2. every owner compares its members with the new entries. Members that keep their entry stay
   where they are and are written in place; only those that change it go through the next
   shuffle, to the owner of their new entry.

Large entries are spread over salts, one for each ``OWNED`` members, so an entry may hold any
share of the parts. What a round leaves is a written table, so a lost executor repeats one
round only. The last assignment goes over the vectors themselves, once all entries are
known, and shuffles nothing but one sum for each label and task.

A component ``x`` counts as ``floor(1024 * x)``, kept between ``-2**26`` and ``2**26`` so that all
sums fit 64 bits (a part of over 256 components of that size would not). Vectors that are null or empty, or hold
null or non-finite components, are left out, and so are vectors of another length
than the kept vector of smallest id (null ids last; of a repeated id the smaller vector).
Lengths that four does not divide are filled up with zeros at the end. A repeated id is a
vector of its own each time. Fewer than 256 vectors give as many entries as vectors. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackweave.session import cut_lineage

POSITIONS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
MOST = 1 << 26
#: members of an entry for each salt
OWNED = 1 << 13
#: components compared at a time, times entries
LOT = 1 << 20


@dataclass
class Codebooks:
    """``entries[p, e]`` is entry ``e`` for part ``p`` of vectors of ``length`` components."""

    entries: np.ndarray
    length: int

    @property
    def width(self) -> int:
        return self.entries.shape[2]


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""

    def there(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    return F.coalesce(F.forall(vector, there), F.lit(False))


def whole(vector: Column, length: int) -> Column:
    """A vector in whole numbers, filled up to a length that the positions divide."""
    most = F.lit(float(MOST))
    numbers = F.transform(vector, lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * SCALE))).cast("int"))
    more = -length % POSITIONS
    return F.concat(numbers, F.array_repeat(F.lit(0), more)) if more else numbers


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, width)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the first one on ties, and the squared distance."""
    wide = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # doubles are exact below 2 ** 53 and multiply faster
    kind = np.float64 if 4 * wide * wide * parts.shape[1] < 1 << 53 else np.int64
    x, c = parts.astype(kind), entries.astype(kind)
    own, near, far = (c * c).sum(axis=1), [], []
    step = max(1, LOT // max(1, len(entries)))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        rest = own - 2 * (some @ c.T)
        best = rest.argmin(axis=1)
        near.append(best)
        far.append(rest[np.arange(len(some)), best] + (some * some).sum(axis=1))
    return np.concatenate(near).astype(np.int32), np.concatenate(far).astype(np.int64)


def _first_owners(books: Codebooks) -> Callable:
    """Cuts vectors into parts and names the nearest entry of each."""
    width, entries = books.width, books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("v"), POSITIONS * width)
            draw = batch.column("draw")
            for p in range(POSITIONS):
                parts = np.ascontiguousarray(rows[:, p * width : (p + 1) * width])
                yield _part_rows(np.full(len(rows), p, np.int32), nearest(parts, entries[p])[0], draw, parts)

    return run


PARTS = "position int, entry int, draw int, part array<int>"


def _part_rows(position: np.ndarray, entry: np.ndarray, draw: pa.Array, parts: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(parts.reshape(-1).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(position), pa.array(entry), draw, lists], names=["position", "entry", "draw", "part"])


def _owned_sums(width: int) -> Callable:
    """What an owner knows of its entries: one row for each, with the count and sum of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((POSITIONS * ENTRIES, width), dtype=np.int64)
        counts = np.zeros(POSITIONS * ENTRIES, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("position").to_numpy() * ENTRIES + batch.column("entry").to_numpy()
            parts = _matrix(batch.column("part"), width)
            order = np.argsort(key, kind="stable")
            keys, starts = np.unique(key[order], return_index=True)
            sums[keys] += np.add.reduceat(parts[order].astype(np.int64), starts, axis=0)
            counts += np.bincount(key, minlength=len(counts))
        known = np.flatnonzero(counts)
        ends = np.arange(len(known) + 1, dtype=np.int32) * width
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[known].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(counts[known]), lists], names=["key", "n", "sums"])

    return run


def updated(books: Codebooks, members: DataFrame) -> tuple[Codebooks, list[int]]:
    """The codebooks after one update and the number of members of each entry."""
    owned = members.mapInArrow(_owned_sums(books.width), "key int, n long, sums array<bigint>")
    added = owned.select("key", "n", F.posexplode("sums").alias("i", "s")).groupBy("key", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    entries, counts = books.entries.copy(), [0] * (POSITIONS * ENTRIES)
    for key, i, n, s in added.collect():  # at most as many rows as the codebooks have numbers
        entries[key // ENTRIES, key % ENTRIES, i] = s // n
        counts[key] = n
    return Codebooks(entries, books.length), counts


def _dealt(parts: DataFrame, counts: list[int]) -> DataFrame:
    """Parts sent to the owners of their entries; an entry has a salt for each ``OWNED`` members it had."""
    salts = F.get(F.lit([n // OWNED + 1 for n in counts]), F.col("position") * ENTRIES + F.col("entry"))
    return parts.repartition("position", "entry", F.pmod("draw", salts))


def _moves(books: Codebooks) -> Callable:
    """The members of an owner with the entry they belong to now and whether that is another one."""
    width, entries = books.width, books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            position, entry = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            parts = _matrix(batch.column("part"), width)
            now = entry.copy()
            for p in np.unique(position):
                here = position == p
                now[here] = nearest(parts[here], entries[p])[0]
            rows = _part_rows(position, now, batch.column("draw"), parts)
            yield rows.append_column("moves", pa.array(now != entry))

    return run


def _kept(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.where(finite(F.col(vector))).where(F.size(vector) > 0)


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> Codebooks | None:
    """The codebooks after the last round; none if no vector is kept."""
    rows = _kept(vectors, vector).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    start = rows.orderBy(*order).limit(1).collect()
    if not start:
        return None
    length = len(start[0]["v"])
    rows = rows.where(F.size("v") == length)
    numbers = whole(F.col("v"), length).alias("v")
    start = np.array([r["v"] for r in rows.orderBy(*order).limit(ENTRIES).select(numbers).collect()], dtype=np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), POSITIONS, -1).transpose(1, 0, 2)), length)

    draw = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)).cast("int").alias("draw")
    # nothing is known of the entries yet: each may hold all parts of its position
    counts = [rows.count()] * (POSITIONS * ENTRIES)
    members = cut_lineage(_dealt(rows.select(draw, numbers).mapInArrow(_first_owners(books), PARTS), counts))
    for left in range(rounds - 1, -1, -1):
        books, counts = updated(books, members)
        if left:
            now = cut_lineage(members.mapInArrow(_moves(books), PARTS + ", moves boolean"))
            arriving = cut_lineage(_dealt(now.where("moves").drop("moves"), counts))
            members = now.where("NOT moves").drop("moves").unionByName(arriving)
    return books


def codebooks_sha256(books: Codebooks) -> str:
    """Of all components in decimal, by position, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.entries.reshape(-1).tolist())).encode()).hexdigest()


def _encode(books: Codebooks) -> Callable:
    width, entries = books.width, books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("v"), POSITIONS * width)
            codes, error = np.zeros((len(rows), POSITIONS), dtype=np.uint8), np.zeros(len(rows), dtype=np.int64)
            for p in range(POSITIONS):
                codes[:, p], far = nearest(rows[:, p * width : (p + 1) * width], entries[p])
                error += far
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def encoded(vectors: DataFrame, books: Codebooks, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, code, error)`` of every kept vector: two hex digits for each part, squared distances summed."""
    rows = _kept(vectors, vector).where(F.size(vector) == books.length)
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector), books.length).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_encode(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codes(vectors: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every kept vector."""
    books = fit(vectors)
    if books is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        none = f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], none)
    rows = cut_lineage(encoded(vectors, books))
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    met = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
