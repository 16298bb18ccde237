"""Near-duplicate vectors by collision counting on random projections.

Every vector is projected on many random directions. Two vectors *collide* in a projection
when one lies in the window around the other; the window is a multiple of the spread that
a pair at the threshold has there. Pairs are counted over all projections, and those with
at least the recall-calibrated number of collisions are verified by their cosine in double
precision.

A window holds a fixed share of all vectors, so counting over whole projections would emit
a share of all pairs. The projections are therefore sorted and counted inside cells: the
signs of a few other projections name the cell of a vector in each of several tables, and
the number of tables is set so that a pair at the threshold meets in one with the asked
recall. More vectors get more signs and more tables; no cell is capped. A large cell is
cut in blocks by hash, and each pair of blocks is handled by itself.

Equal vectors are handled once, with their number. A pair that meets in several tables is
counted in the first one only, which each task can tell from the two vectors alone; tasks
send counts and a spanning set of links, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different length link with nothing; repeated rows count as
vectors of their own; a null id takes part but is never the smallest; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackweave.llm.components import components
from trackweave.llm.runs import runs
from trackweave.session import cut_lineage

BLOCK = 512
FEW = 64  # rows whose pairs are compared without ranks: the same windows, one array operation
PER_CELL = 16  # vectors of a cell on average, if they were spread evenly
WINDOW = 2.0  # half window in spreads of a pair at the threshold
PROJECTIONS = 48
MISSED = 1e-4  # share of pairs at the threshold that may fail the count


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _least_count(n: int, p: float, missed: float) -> int:
    """The largest count that a pair colliding with probability ``p`` reaches in all but ``missed`` cases."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > missed:
            return k
    return n


@dataclass(frozen=True)
class Projections:
    """Directions, window and number of collisions, fitted to the threshold and the table's size."""

    dim: int
    cosine: float
    signs: int  # per table
    tables: int
    seed: int = 7

    @staticmethod
    def fit(dim: int, cosine: float, n: int, recall: float) -> "Projections":
        signs = max(1, math.ceil(math.log2(max(2.0, n / PER_CELL))))
        same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** signs
        tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-same))) if same < 1 else 1
        return Projections(dim, cosine, signs, tables)

    @property
    def half_window(self) -> float:
        return WINDOW * math.sqrt(max(0.0, 2 - 2 * self.cosine))

    @property
    def least_count(self) -> int:
        return _least_count(PROJECTIONS, 1 - 2 * _normal_tail(WINDOW), MISSED)

    def directions(self) -> np.ndarray:
        """Columns: the signs of all tables, then the counted projections; entries are standard normal."""
        draw = np.random.Generator(np.random.Philox(self.seed))
        return draw.standard_normal((self.dim, self.tables * self.signs + PROJECTIONS))

    def project(self, unit: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(cell of each vector in each table, counted projections)``."""
        # one row after another, so that a value never depends on the batch it comes in
        values = np.stack([v @ directions for v in unit]) if len(unit) else np.zeros((0, directions.shape[1]))
        bits = (values[:, : self.tables * self.signs] > 0).reshape(len(unit), self.tables, self.signs)
        cells = np.zeros((len(unit), self.tables), dtype=np.int64)
        for j in range(self.signs):
            cells = (cells << 1) | bits[:, :, j]
        return cells, values[:, self.tables * self.signs :]


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(how: Projections):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = how.directions()
        for batch in batches:
            got, _ = how.project(_units(batch.column("embedding"), how.dim), directions)
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict(
                {
                    "cls": pa.array(np.repeat(batch.column("cls").to_numpy(), how.tables)),
                    "tab": pa.array(np.tile(np.arange(how.tables, dtype=np.int32), n)),
                    "cell": pa.array(got.reshape(-1)),
                }
            )

    return cells


def collisions(projected: np.ndarray, half: float) -> np.ndarray:
    """Number of projections in which each pair collides, as a matrix.

    Each projection is sorted; the window centred at a vector is a range of ranks, and a pair collides where
    the one's rank is in the other's range. In few rows the ranges are read off the values themselves.
    """
    n, many = projected.shape
    if n <= FEW:
        low, high = projected - half, projected + half
        return ((projected >= low[:, None]) & (projected <= high[:, None])).sum(axis=2, dtype=np.int16)
    count = np.zeros((n, n), dtype=np.int16)
    kind = np.int16 if n < 1 << 15 else np.int64
    order = np.argsort(projected, axis=0, kind="stable")
    rank, places = np.empty(n, dtype=kind), np.arange(n, dtype=kind)
    for j in range(many):
        own = projected[:, j]
        line = own[order[:, j]]
        rank[order[:, j]] = places
        low = np.searchsorted(line, own - half, side="left").astype(kind)
        high = np.searchsorted(line, own + half, side="right").astype(kind)
        count += rank >= low[:, None]
        count -= rank >= high[:, None]
    return count


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first row that links reach from each row."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _linked(how: Projections):
    """Per tile the number of linked vectors of each class and a spanning set of links."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = how.directions()
        held: dict[str, list[np.ndarray]] = {"cls": [], "links": [], "root": []}
        n_held = 0
        for tile in runs(batches, ["tab", "cell", "lo", "hi"]):
            n = tile.num_rows
            if n < 2:
                continue
            unit = _units(tile.column("embedding"), how.dim)
            cls, copies, block = (tile.column(c).to_numpy() for c in ("cls", "copies", "block"))
            tab, lo, hi = (tile.column(c)[0].as_py() for c in ("tab", "lo", "hi"))
            cells, projected = how.project(unit, directions)
            x, y = np.nonzero(np.triu(collisions(projected, how.half_window) >= how.least_count, 1))
            if lo != hi:
                apart = block[x] != block[y]
                x, y = x[apart], y[apart]
            if tab:
                new = ~(cells[x, :tab] == cells[y, :tab]).any(axis=1)  # not met in an earlier table
                x, y = x[new], y[new]
            near = np.empty(len(x), dtype=bool)
            for i in range(0, len(x), 1 << 14):
                part = slice(i, i + (1 << 14))
                near[part] = (unit[x[part]] * unit[y[part]]).sum(axis=1) >= how.cosine
            x, y = x[near], y[near]
            if not len(x):
                continue
            links = np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
            by_class = np.argsort(cls, kind="stable")
            place = np.empty(n, dtype=np.int64)
            place[by_class] = np.arange(n)
            root = _roots(n, place[x], place[y])
            there = np.flatnonzero(links)
            held["cls"].append(cls[there])
            held["links"].append(links[there].astype(np.int64))
            held["root"].append(cls[by_class][root[place[there]]])
            n_held += len(there)
            if n_held > 100_000:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in held.items()})
                held, n_held = {"cls": [], "links": [], "root": []}, 0
        if n_held:
            yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in held.items()})

    return linked


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``(vec_id, embedding)``."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(sound & F.exists("embedding", lambda x: x != 0), F.lit(False))
    named = cut_lineage(
        rows.withColumn("_ok", usable)
        # equal vectors share this name; -0.0 is turned into 0.0
        .withColumn("_name", F.when(F.col("_ok"), F.md5(F.transform("embedding", lambda x: x + 0).cast("string").cast("binary"))))
    )
    good = named.where("_ok")
    classes = cut_lineage(
        good.groupBy("_name").agg(
            F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
        ).withColumn("cls", F.xxhash64("_name"))
    )
    sizes = [(r["d"], r["count"]) for r in classes.groupBy(F.size("embedding").alias("d")).count().collect()]
    counted = None
    for dim, n in sizes:  # one length in any sound table
        how = Projections.fit(dim, cosine, n, recall)
        own = classes.where(F.size("embedding") == dim).select("cls", "copies", "embedding")
        cells = cut_lineage(own.mapInArrow(_cells(how), "cls bigint, tab int, cell bigint"))
        full = cells.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        placed = cells.join(full, ["tab", "cell"]).withColumn("blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("cls", "tab"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tile = ["tab", "cell", "lo", "hi"]
        dealt = placed.select(
            "tab", "cell", "cls", "block", F.least("block", "_with").alias("lo"), F.greatest("block", "_with").alias("hi")
        )
        ready = dealt.join(own, "cls").repartition(*tile).sortWithinPartitions(*tile)
        found = ready.mapInArrow(_linked(how), "cls bigint, links bigint, root bigint")
        counted = found if counted is None else counted.union(found)
    kinds = "cls bigint, links bigint, root bigint"
    counted = cut_lineage(counted if counted is not None else vectors.sparkSession.createDataFrame([], kinds))
    links = counted.groupBy("cls").agg(F.sum("links").alias("links"))
    found = components(counted.select("cls", "root"))
    tied = classes.select("_name", "cls", "first", "copies").join(
        found.select(F.col("node").alias("cls"), F.col("component").alias("_c")), "cls", "left"
    )
    tied = tied.withColumn("_c", F.coalesce("_c", "cls")).join(links, "cls", "left")
    least = tied.groupBy("_c").agg(F.min("first").alias("component_id"))
    known = tied.join(least, "_c").select(
        "_name", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return named.join(known, "_name", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
