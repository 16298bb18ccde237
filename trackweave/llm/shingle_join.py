"""Exact self-join of texts on the Jaccard similarity of their word shingles.

Texts with equal shingle sets are one *node*. Links are found in three steps; whatever
the first two do, the last one completes the components exactly:

1. *Hubs.* Nodes that share a minimum hash share a few hubs, picked in several orders. A
   node is verified with the hubs it agrees with most, so families of near copies become
   components without pairing their members.
2. *Tiles.* Two sets that are similar enough share one of the first ``n - ceil(t n) + 1``
   shingles in any common order. Shingles that a fixed-size count sketch finds frequent go
   last in that order, so passages shared by many texts are rarely among the first ones. A
   tile holds the nodes with one such shingle in one size band or the next longer one
   (sizes of a pair are at most one band apart). Tiles of one component are dropped. In
   the others bit counts of hashed bitmap signatures bound the overlap from above, and in a few tiles of each node
   the pairs of highest bound that would tie a tile together are verified by exact intersection of sorted arrays.
3. Tiles that still hold several components are gone over again, now with every pair across
   components that the bound lets pass.

A large tile is cut in blocks of nodes by hash, and each pair of blocks is a task's tile.

Defined cases: null or empty texts, and texts without words, have no shingles and link
with nothing; fewer words than a shingle form one shingle; repeated rows and equal texts
belong to one component; a row without id belongs to the component of an equal text that
has one, else to none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trackweave.llm.components import components
from trackweave.llm.runs import whole_runs
from trackweave.llm.words import mix, shingles, word_pieces
from trackweave.session import cut_lineage

SIZE = 5
CELLS = 1 << 18  # counters of the sketch
SLICES = 64
MINIMA = 16
AGREE = 10  # minimum hashes that a node and its hub share
HUBS = 6  # orders in which hubs are picked
TRIED = 3  # hubs of a node that are verified
BLOCK = 256  # nodes of one block of a large tile
FEW = 4  # tiles of a node that the first round goes over
MET = 16  # first shingles of a node by which the last round knows where a pair has met before
HELD = 1 << 19  # shingles that a task holds before it hands them on
TOGETHER = 48  # tiles of up to so many rows are gone over together
MOST_SENT = 4_000_000  # ids broadcast at once (32 MB); beyond it texts are joined by a shuffle


@dataclass(frozen=True)
class Threshold:
    """Similarity ``part / whole`` as whole numbers, so that comparisons are exact."""

    part: int = 75
    whole: int = 100

    def first(self, n: int) -> int:
        """How many first shingles of ``n`` a similar set must share one of."""
        return n - -(-self.part * n // self.whole) + 1

    def linked(self, shared, a, b):
        return self.whole * shared >= self.part * (a + b - shared)

    def band(self, n: np.ndarray) -> np.ndarray:
        """Size band: sizes of a similar pair are in one band or in neighbouring ones."""
        return np.floor(np.log(n) / np.log(self.whole / self.part) + 1e-9).astype(np.int32)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` of every text."""
    for row, words in word_pieces(column):
        hashes, first = shingles(words, size)
        cuts = first.tolist()
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            part = np.sort(hashes[a:b])
            if b - a > 1:
                keep = np.empty(b - a, dtype=bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
            yield row + i, part


def _node(part: np.ndarray) -> int:
    """64-bit name of a set."""
    both = np.array([np.add.reduce(part), np.bitwise_xor.reduce(mix(part))], dtype=np.uint64)
    return int(mix(mix(both[:1]) + both[1:] + np.uint64(len(part))).view(np.int64)[0])


def _cells(part: np.ndarray) -> np.ndarray:
    return (part >> np.uint64(46)).astype(np.int64)


def _described(size: int):
    """Per text its node, size and minimum hashes; per task its part of the sketch."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            nodes, sizes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            minima: list[list[int] | None] = [None] * n
            cells, held = [], 0
            for row, part in _sets(batch.column("text"), size):
                sizes[row] = len(part)
                if len(part):
                    nodes[row] = _node(part)
                    cells.append(_cells(part))
                    held += len(part)
                    if held > HELD:
                        sketch += np.bincount(np.concatenate(cells), minlength=CELLS)
                        cells, held = [], 0
                    slot = (part & np.uint64(MINIMA - 1)).astype(np.int64)
                    there, at = np.unique(slot, return_index=True)
                    minima[row] = (part[at] & ~np.uint64(MINIMA - 1) | there.astype(np.uint64)).view(np.int64).tolist()
            if cells:
                sketch += np.bincount(np.concatenate(cells), minlength=CELLS)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(sizes),
                    "node": pa.array(nodes, mask=sizes == 0),
                    "minima": pa.array(minima, pa.list_(pa.int64())),
                    "slice": pa.nulls(n, pa.int32()),
                    "counts": pa.nulls(n, pa.binary()),
                }
            )
        if sketch.any():
            step = CELLS // SLICES
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.nulls(SLICES, pa.int64()),
                    "n": pa.nulls(SLICES, pa.int64()),
                    "node": pa.nulls(SLICES, pa.int64()),
                    "minima": pa.nulls(SLICES, pa.list_(pa.int64())),
                    "slice": pa.array(np.arange(SLICES, dtype=np.int32)),
                    "counts": pa.array([sketch[i * step : (i + 1) * step].tobytes() for i in range(SLICES)], pa.binary()),
                }
            )

    return describe


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(data, dtype=np.int64)
            sums[i] = sums[i] + part if i in sums else part
    if sums:
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())}
        )


def _frequent(slices: DataFrame) -> np.ndarray:
    """Cells far above what evenly spread shingles would put there. Of fixed size."""
    got = slices.repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary").collect()
    sketch = np.zeros(CELLS, dtype=np.int64)
    step = CELLS // SLICES
    for r in got:
        sketch[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["counts"], dtype=np.int64)
    usual = float(np.median(sketch))
    return sketch > usual + 8 * np.sqrt(usual) + 8


def _fetched(sent, size: int):
    """``(node, n, part)`` of the texts whose id is wanted."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent is None else sent.value
        for batch in batches:
            if wanted is not None:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
                batch = batch.filter(pa.array(wanted[at] == ids))
            nodes, sizes, parts, held = [], [], [], 0
            for _, part in _sets(batch.column("text"), size):
                if len(part):
                    nodes.append(_node(part))
                    sizes.append(len(part))
                    parts.append(part.tobytes())
                    held += len(part)
                if held > HELD:
                    yield _named(nodes, sizes, parts)
                    nodes, sizes, parts, held = [], [], [], 0
            if nodes:
                yield _named(nodes, sizes, parts)

    return fetch


def _named(nodes: list[int], sizes: list[int], parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int64()), "part": pa.array(parts, pa.binary())}
    )


def _intersected(rule: Threshold):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("part_a"), batch.column("part_b")):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int(np.count_nonzero(y[at] == x))
                linked.append(rule.linked(common, len(x), len(y)))
            out = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            if out.num_rows:
                yield out

    return check


def _own(part: np.ndarray, late: np.ndarray, rule: Threshold) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order, and how many of them are rare."""
    k = rule.first(len(part))
    flag = late[_cells(part)]
    rare = part[~flag]
    own = rare[:k] if len(rare) >= k else np.concatenate([rare, part[flag][: k - len(rare)]])
    return own, len(rare)


def _order(keys: np.ndarray) -> np.ndarray:
    """The order in which a few of the first shingles are chosen."""
    return mix(keys ^ np.uint64(0xD1B54A32D192ED03))


def _firsts(frequent, rule: Threshold, size: int):
    """``(key, node, n, often, few)``: the first shingles of every text in the common order; ``few`` marks ``FEW`` of them.

    Those marked are the smallest by hash, so similar sets have most of them in common.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            keys, nodes, sizes, often, few, held = [], [], [], [], [], 0
            for _, part in _sets(batch.column("text"), size):
                n = len(part)
                if not n:
                    continue
                if held > HELD:
                    yield _first_rows(keys, nodes, sizes, often, few)
                    keys, nodes, sizes, often, few, held = [], [], [], [], [], 0
                own, rare = _own(part, late, rule)
                k = len(own)
                keys.append(own)
                nodes.append(np.full(k, _node(part), dtype=np.int64))
                sizes.append(np.full(k, n, dtype=np.int32))
                often.append(np.arange(k) >= rare)
                order = _order(own)
                few.append(order <= np.partition(order, FEW - 1)[FEW - 1] if k > FEW else np.ones(k, dtype=bool))
                held += k
            if keys:
                yield _first_rows(keys, nodes, sizes, often, few)

    return first


def _first_rows(keys, nodes, sizes, often, few) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array(np.concatenate(keys).view(np.int64)),
            "node": pa.array(np.concatenate(nodes)),
            "n": pa.array(np.concatenate(sizes)),
            "often": pa.array(np.concatenate(often)),
            "few": pa.array(np.concatenate(few)),
        }
    )


def bitmap(part: np.ndarray) -> bytes:
    """Parities of the shingles per bit, with at least as many bits as shingles."""
    bits = 1 << max(6, (len(part) - 1).bit_length())
    at = (mix(part ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(data: bytes | pa.Buffer, width: int) -> np.ndarray:
    """A signature in ``width`` 64-bit words; folding keeps the parity of each bit."""
    x = np.frombuffer(data, dtype=np.uint64)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _marked(frequent, rule: Threshold):
    """``(node, bits, least)``: the signature of each set and the ``MET`` smallest of its first shingles by hash, in that order."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            maps, least = [], []
            for value in batch.column("part"):
                part = np.frombuffer(value.as_buffer(), dtype=np.uint64)
                maps.append(bitmap(part))
                own, _ = _own(part, late, rule)
                chosen = np.zeros(MET, dtype=np.uint64)
                some = own[np.argsort(_order(own), kind="stable")[:MET]]
                chosen[: len(some)] = some
                least.append(chosen.tobytes())
            yield pa.RecordBatch.from_pydict(
                {"node": batch.column("node"), "bits": pa.array(maps, pa.binary()), "least": pa.array(least, pa.binary())}
            )

    return mark


def _signatures(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The signatures of some rows, in ``width`` words each."""
    out = np.empty((len(rows), width), dtype=np.uint64)
    for k, i in enumerate(rows.tolist()):
        out[k] = _folded(column[i].as_buffer(), width)
    return out


@dataclass
class Tiles:
    """Rows of whole tiles, tile after tile."""

    rule: Threshold
    table: pa.Table

    def __post_init__(self) -> None:
        columns = ("key", "band", "lo", "hi", "node", "n", "comp", "own", "block")
        self.at = {c: self.table.column(c).to_numpy() for c in columns}
        self.bits = self.table.column("bits").combine_chunks()
        self.least = np.frombuffer(b"".join(self.table.column("least").to_pylist()), dtype=np.uint64)
        self.least = self.least.reshape(self.table.num_rows, -1)
        new = np.ones(len(self.at["key"]), dtype=bool)
        new[1:] = np.any([self.at[c][1:] != self.at[c][:-1] for c in columns[:4]], axis=0)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(new)))
        self.tile = np.cumsum(new) - 1
        # components of one tile, numbered over all tiles
        order = np.lexsort((self.at["comp"], self.tile))
        turn = np.ones(len(order), dtype=bool)
        turn[1:] = (self.tile[order][1:] != self.tile[order][:-1]) | (self.at["comp"][order][1:] != self.at["comp"][order][:-1])
        self.comp_in_tile = np.empty(len(order), dtype=np.int64)
        self.comp_in_tile[order] = np.cumsum(turn)
        self.words = 1 << np.maximum(0, np.frexp(np.minimum.reduceat(self.at["n"], self.start) - 1.0)[1] - 6)

    def tested(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether two rows of a tile are to be compared."""
        comp, own, block = self.at["comp"], self.at["own"], self.at["block"]
        one = self.at["lo"][x] == self.at["hi"][x]
        return (comp[x] != comp[y]) & ((own[x] == 1) | (own[y] == 1)) & (one | (block[x] != block[y]))

    def bounded(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the bound lets pairs pass, and the likeness it stands for."""
        both = self.at["n"][x].astype(np.int64) + self.at["n"][y]
        most = (both - apart) // 2
        return self.rule.whole * most >= self.rule.part * (both - most), most / (both - most)

    def small(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs ``(x, y, likeness)`` of all tiles of up to ``TOGETHER`` rows, at once for every distance in the tile."""
        few = (self.size > 1) & (self.size <= TOGETHER)
        for width in np.unique(self.words[few]).tolist():
            rows = np.flatnonzero((few & (self.words == width))[self.tile])
            tile, marks = self.tile[rows], None
            for d in range(1, TOGETHER):
                near = np.flatnonzero(tile[:-d] == tile[d:]) if d < len(rows) else rows[:0]
                if not len(near):
                    break
                near = near[self.tested(rows[near], rows[near + d])]
                if not len(near):
                    continue
                if marks is None:
                    marks = _signatures(self.bits, rows, width)
                step = max(1, (1 << 21) // width)
                for lo in range(0, len(near), step):
                    some = near[lo : lo + step]
                    apart = np.bitwise_count(marks[some] ^ marks[some + d]).sum(axis=1, dtype=np.int64)
                    x, y = rows[some], rows[some + d]
                    ok, like = self.bounded(x, y, apart)
                    yield x[ok], y[ok], like[ok]

    def large(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of the other tiles, some rows of a tile against all of it."""
        for k in np.flatnonzero(self.size > TOGETHER).tolist():
            rows = np.arange(self.start[k], self.start[k] + self.size[k])
            width = int(self.words[k])
            marks = _signatures(self.bits, rows, width)
            step = max(1, (1 << 21) // (len(rows) * width))
            for lo in range(0, len(rows), step):
                x, y = (g.ravel() for g in np.meshgrid(rows[lo : lo + step], rows, indexing="ij"))
                wanted = (x < y) & self.tested(x, y)
                x, y = x[wanted], y[wanted]
                if not len(x):
                    continue
                at = int(rows[0])
                apart = np.bitwise_count(marks[x - at] ^ marks[y - at]).sum(axis=1, dtype=np.int64)
                ok, like = self.bounded(x, y, apart)
                yield x[ok], y[ok], like[ok]

    def forest(self, x: np.ndarray, y: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of highest bound that tie the components of each tile together, one fewer than components."""
        names = np.concatenate([self.comp_in_tile[x], self.comp_in_tile[y]])
        names, ends = np.unique(names, return_inverse=True)
        u, v = ends[: len(x)], ends[len(x) :]
        kept, left = [], np.arange(len(x))
        while len(left):
            side = np.concatenate([u[left], v[left]])
            order = np.lexsort((np.tile(left, 2), -np.tile(like[left], 2), side))
            first = np.ones(len(order), dtype=bool)
            first[1:] = side[order][1:] != side[order][:-1]
            best = np.unique(left[order[first] % len(left)])
            kept.append(best)
            root = _roots(len(names), u[best], v[best])
            u, v = root[u], root[v]
            left = left[u[left] != v[left]]
        kept = np.concatenate(kept) if kept else left
        return x[kept], y[kept]

    def first_met(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs are known not to meet in a tile that comes before this one.

        Two rows with a shingle in common among the least of each are both in its tile.
        """
        met = np.zeros(len(x), dtype=bool)
        for lo in range(0, len(x), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            here = _order(self.at["key"][x[part]].view(np.uint64))
            a, b = self.least[x[part]], self.least[y[part]]
            for i in range(a.shape[1]):
                before = (a[:, i] != 0) & (_order(a[:, i]) < here)
                met[part] |= before & (a[:, i : i + 1] == b).any(axis=1)
        return ~met

    def pairs(self, best: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node = self.at["node"]
        parts = [*self.small()]
        together = [tuple(np.concatenate(c) for c in zip(*parts))] if parts else []
        for found in chain(together, self.large()):
            if best:
                x, y = self.forest(*found)
            else:
                x, y = found[:2]
                first = self.first_met(x, y)
                x, y = x[first], y[first]
            yield node[x], node[y]


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that links reach from each number."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _candidates(rule: Threshold, best: bool):
    """Pairs of a tile in different components whose bound on the overlap is high enough.

    With ``best`` only the pairs of highest bound that would tie a tile's components together are given.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0
        for table in whole_runs(batches, ["key", "band", "lo", "hi"]):
            for x, y in Tiles(rule, table).pairs(best):
                held.append((x, y))
                n_held += len(x)
                if n_held > 200_000:
                    yield _pairs(held)
                    held, n_held = [], 0
        if n_held:
            yield _pairs(held)

    return pair


def _pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate(c) for c in zip(*held))
    both = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
    return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy())})


class Join:
    """The similarity self-join of ``docs`` on ``text``; ``doc_id`` is a whole number."""

    def __init__(self, docs: DataFrame, rule: Threshold = Threshold(), size: int = SIZE):
        self.rule, self.size = rule, size
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        kinds = "doc_id bigint, n bigint, node bigint, minima array<bigint>, slice int, counts binary"
        every = cut_lineage(self.docs.mapInArrow(_described(size), kinds))
        self.texts = every.where("slice IS NULL").select("doc_id", "n", "node", "minima")
        self.frequent = self.spark.sparkContext.broadcast(_frequent(every.where("slice IS NOT NULL").select("slice", "counts")))
        # one text of each node stands for it
        self.nodes = cut_lineage(
            self.texts.where("node IS NOT NULL AND doc_id IS NOT NULL")
            .groupBy("node")
            .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("minima").alias("minima"))
        )

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """``(node, n, part)`` of the given distinct nodes, made anew from their texts.

        ``nodes`` comes from a written table: it is counted without the join.
        """
        ids = self.nodes.join(nodes, "node").select("doc_id")
        if nodes.count() <= MOST_SENT:
            wanted = np.sort(ids.toArrow().column(0).to_numpy())
            if not len(wanted):
                return self.spark.createDataFrame([], "node bigint, n bigint, part binary")
            sent = self.spark.sparkContext.broadcast(wanted)
            rows = self.docs.where("doc_id IS NOT NULL").mapInArrow(_fetched(sent, self.size), "node bigint, n bigint, part binary")
        else:
            rows = self.docs.join(ids, "doc_id", "left_semi").mapInArrow(
                _fetched(None, self.size), "node bigint, n bigint, part binary"
            )
        # a repeated id brings its other texts along: keep the sets asked for
        return rows.dropDuplicates(["node"]).join(nodes, "node", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that are linked, by the exact intersection of their sets."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        sets = cut_lineage(self.sets_of(cut_lineage(ends))).select("node", "part")
        left = sets.select(F.col("node").alias("a"), F.col("part").alias("part_a"))
        right = sets.select(F.col("node").alias("b"), F.col("part").alias("part_b"))
        return pairs.join(left, "a").join(right, "b").mapInArrow(_intersected(self.rule), "a bigint, b bigint")

    def hub_pairs(self) -> DataFrame:
        """Each node with the hubs it shares most minimum hashes with.

        Every minimum hash has a hub in each of several orders of the nodes.
        """
        each = self.nodes.select("node", F.explode("minima").alias("value"))
        order = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(HUBS)]
        hubs = each.groupBy("value").agg(F.array_distinct(F.array(*order)).alias("hubs"), F.count(F.lit(1)).alias("_n"))
        hubs = hubs.where("_n > 1").select("value", F.explode("hubs").alias("hub"))
        # dealt by node: the counts and the ranks of a node, at most MINIMA * HUBS rows, take one exchange
        met = each.join(hubs, "value").where("node <> hub").select("node", "hub").repartition("node")
        agreed = met.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("k"))
        by = Window.partitionBy("node").orderBy(F.desc("k"), "hub")
        tried = agreed.where(F.col("k") >= AGREE).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= TRIED)
        return tried.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()

    def tile_rows(self) -> DataFrame:
        """``(key, node, n, few)``: first shingles that several nodes have."""
        kinds = "key bigint, node bigint, n int, often boolean, few boolean"
        firsts = self.docs.where("doc_id IS NOT NULL").mapInArrow(_firsts(self.frequent, self.rule, self.size), kinds)
        # texts of equal sets give equal rows; rare shingles have short runs by the sketch
        rare = firsts.where("NOT often").repartition("key").groupBy("key", "node", "n").agg(F.max("few").alias("few"))
        shared = rare.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("_c > 1")
        heavy = firsts.where("often").select("key", "node", "n", "few").distinct()
        return shared.select("key", "node", "n", "few").union(heavy)

    def open_tiles(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows of the tiles with several components; a tile has one band and the next longer one."""
        rows = rows.join(known, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        band = F.floor(F.log("n") / F.log(F.lit(self.rule.whole / self.rule.part)) + 1e-9).cast("int")
        place = lambda b, own: F.struct(b.alias("band"), F.lit(own).alias("own"))
        rows = rows.withColumn("_band", band)
        rows = rows.withColumn("_in", F.explode(F.array(place(F.col("_band"), 1), place(F.col("_band") - 1, 0))))
        rows = cut_lineage(rows.select("key", "node", "n", "few", "comp", "_in.band", "_in.own"))
        tiles = (
            rows.groupBy("key", "band")
            .agg(F.min("comp").alias("_c0"), F.max("comp").alias("_c1"), F.max("own").alias("_own"), F.count(F.lit(1)).alias("_n"))
            .where("_c0 <> _c1 AND _own = 1")
            .select("key", "band", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
        )
        return cut_lineage(rows.join(tiles, ["key", "band"]))

    def tile_pairs(self, open_rows: DataFrame, marks: DataFrame, best: bool) -> DataFrame:
        """Candidate pairs of the open tiles; large tiles as pairs of blocks."""
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = open_rows.withColumn("block", block).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select(
            "key", "band", "node", "n", "comp", "own", "block",
            F.least("block", "_with").alias("lo"), F.greatest("block", "_with").alias("hi"),
        )
        tile = ["key", "band", "lo", "hi"]
        ready = dealt.join(marks, "node").repartition(*tile).sortWithinPartitions(*tile)
        return ready.mapInArrow(_candidates(self.rule, best), "a bigint, b bigint").distinct()

    def marks(self, nodes: DataFrame) -> DataFrame:
        return self.sets_of(nodes).mapInArrow(_marked(self.frequent, self.rule), "node bigint, bits binary, least binary")

    def components(self) -> DataFrame:
        """``(node, component)`` of all nodes that links tie to a smaller one.

        After the hubs, a round over ``FEW`` tiles of each node verifies the pairs of highest bound that would tie a tile
        together; what they do tie together needs no further pairs. The last round takes all tiles and every pair
        across components that the bound lets pass, once for all tiles before which the two are known to have met.
        """
        known = components(cut_lineage(self.verified(cut_lineage(self.hub_pairs()))))
        rows = cut_lineage(self.tile_rows())
        marks = None
        for best in (True, False):
            rows = self.open_tiles(rows.select("key", "node", "n", "few").distinct() if marks is not None else rows, known)
            if marks is None:
                marks = cut_lineage(self.marks(cut_lineage(rows.select("node").distinct())))
            tiles = rows.where("few") if best else rows
            more = cut_lineage(self.verified(cut_lineage(self.tile_pairs(tiles, marks, best))))
            if not more.isEmpty():
                # what is known ties the same nodes together as the links it came from
                known = components(known.union(more))
        return known

    def classes(self) -> DataFrame:
        """``(doc_id, n_shingles, component_id)`` of every text."""
        found = self.components()
        # the smallest id of a component
        named = self.nodes.select("node", "doc_id").join(found, "node", "left")
        named = named.withColumn("_c", F.coalesce("component", "node")).select("node", "doc_id", "_c")
        least = named.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
        ids = named.join(least, "_c").select("node", "component_id")
        return self.texts.join(ids, "node", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
        )


def near_classes(docs: DataFrame, rule: Threshold = Threshold(), size: int = SIZE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest id that links reach from each text."""
    return Join(docs, rule, size).classes()
