"""Matrix profiles: the nearest other subsequence for every subsequence.

A track is cut into blocks of frames. Every pair of blocks of a track is one
task-sized piece of work: its distances are computed block-wise on arrays and
only the nearest neighbour of each subsequence leaves the task. A long track is
thereby spread over many tasks and no pair of subsequences becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from trackweave.operators.numbering import with_each
from trackweave.session import cut_lineage

BLOCK = 4096
#: a block of a long track grows up to so many frames
MOST_BLOCK = 1 << 20
_CELLS = 125_000
#: numbers of a window up to which products in single precision tell far windows
MOST_QUICK = 128
_QUICK = 2048
_FIRST = 512
#: pairs of blocks of so many frames take seconds
_HEAVY = 1 << 15
#: runs of windows that are bounded at once
_TALL = 256
#: a run of windows with a common core is this part of a window
_CORES = 6
#: what sums in single precision lose below their smallest numbers
_LOST = 1e-34
#: the square of a core that holds a missing frame: above all others, and no product of it is lost
_FAR = 1e37
#: a piece with a larger share of cells that may hold a near pair, for each pair of a cell, is computed as a whole
_NEAR_SHARE = 0.02
_MOST_SHARE = 0.2
#: numbers of reference frames that go to the tasks as a model (64 MB)
MOST_SENT = 8_000_000


class Scratch:
    """Work arrays that are used again: fresh memory costs more than the sums."""

    def __init__(self) -> None:
        self._held = [np.empty(0) for _ in range(5)]

    def get(self, slot: int, shape: tuple[int, ...]) -> np.ndarray:
        size = math.prod(shape)
        if self._held[slot].size < size:
            self._held[slot] = np.empty(size)
        return self._held[slot][:size].reshape(shape)


# one per Python worker
_SCRATCH = Scratch()


def diagonal_sums(part: np.ndarray, m: int, scratch: Scratch = _SCRATCH) -> np.ndarray:
    """Sums of ``m`` neighbours along the diagonals of the last two axes.

    Widths are doubled, which needs no subtraction: equal passages come out as
    exactly 0, and a sum does not depend on the block it is computed in. The
    result is a work array, good until the next call.
    """
    rows, cols = part.shape[-2] - m + 1, part.shape[-1] - m + 1
    total, done, width, slot = None, 0, 1, 0
    while True:
        if m & width:
            piece = part[..., done : done + rows, done : done + cols]
            if total is None:
                total = scratch.get(2, piece.shape)
                np.copyto(total, piece)
            else:
                np.add(total, piece, out=total)
            done += width
        if done == m:
            return total
        here, ahead = part[..., :-width, :-width], part[..., width:, width:]
        part = np.add(here, ahead, out=scratch.get(slot, here.shape))
        slot, width = 1 - slot, 2 * width


def window_distances(
    a: np.ndarray, b: np.ndarray, m: int, scratch: Scratch = _SCRATCH
) -> np.ndarray:
    """Squared distances of all length-``m`` windows of ``a`` and ``b``."""
    out = scratch.get(3, (len(a), len(b)))
    step = max(1, 32_768 // len(b))
    columns = [np.ascontiguousarray(y) for y in b.T]
    # a few rows at a time, so that all dimensions are added up in cache
    for lo in range(0, len(a), step):
        some = a[lo : lo + step]
        part, d = out[lo : lo + step], scratch.get(4, (len(some), len(b)))
        np.subtract(some[:, :1], columns[0], out=part)
        np.multiply(part, part, out=part)
        for k in range(1, len(columns)):
            np.subtract(some[:, k : k + 1], columns[k], out=d)
            np.multiply(d, d, out=d)
            np.add(part, d, out=part)
    return diagonal_sums(out, m, scratch)


def _piece(m: int) -> tuple[int, int]:
    """Rows and columns computed at once: fit for the cache, not mostly overlap."""
    height = max(2 * m, 256)
    return height, max(2 * m, _CELLS // (height + m) - m)


def _finite(d: np.ndarray) -> None:
    """Windows with a missing or non-finite frame are near to nothing."""
    np.copyto(d, np.inf, where=~np.isfinite(d))


def _improve_rows(near: np.ndarray, at: np.ndarray, d: np.ndarray, first: int) -> None:
    """Take row minima of ``d`` that beat ``near``; columns count from ``first``."""
    j = d.argmin(axis=1)
    best = d[np.arange(len(d)), j]
    closer = best < near
    near[closer], at[closer] = best[closer], j[closer] + first


def _improve_cols(near: np.ndarray, at: np.ndarray, d: np.ndarray, first: int) -> None:
    """Take column minima of ``d`` that beat ``near``; rows count from ``first``."""
    best = d.min(axis=0)
    closer = np.flatnonzero(best < near)
    near[closer] = best[closer]
    at[closer] = (d[:, closer] == best[closer]).argmax(axis=0) + first


def _whole(*parts: np.ndarray) -> bool:
    """Whether all frames are finite, so that no distance needs a look."""
    return all(np.isfinite(p).all() for p in parts)


def _hide(d: np.ndarray, gap: int, zone: int) -> None:
    """Rule out pairs at most ``zone`` apart; column 0 is ``gap`` after row 0."""
    cols = min(d.shape[1], max(0, len(d) + zone - gap))
    lag = np.arange(cols)[None, :] + gap - np.arange(len(d))[:, None]
    d[:, :cols][np.abs(lag) <= zone] = np.inf


def _none_yet(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, np.inf), np.full(n, -1, dtype=np.int64)


# Ranges come in ascending order, so an equally near later window never replaces
# an earlier one.


def _runs(frames: np.ndarray, length: int) -> list[np.ndarray]:
    """All runs of ``length`` frames, for each number of a frame."""
    return [np.lib.stride_tricks.sliding_window_view(f, length) for f in np.ascontiguousarray(frames.T)]


def _squares(a: list[np.ndarray], b: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the frames of the runs ``x`` and ``y``, a column for each pair."""
    part = None
    for u, v in zip(a, b):
        d = np.ascontiguousarray((u[x] - v[y]).T)
        np.multiply(d, d, out=d)
        part = d if part is None else np.add(part, d, out=part)
    return part


def pair_distances(a: list[np.ndarray], b: list[np.ndarray], m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the runs ``x`` of ``a`` and ``y`` of ``b``, as ``window_distances`` adds them up."""
    part = _squares(a, b, x, y)
    total, done, width = None, 0, 1
    while True:
        if m & width:
            total = part[done] if total is None else total + part[done]
            done += width
        if done == m:
            return total
        part, width = part[:-width] + part[width:], 2 * width


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the few flags that are set: eight at a time are looked at first."""
    some = len(flags) // 8 * 8
    words = np.flatnonzero(flags[:some].view(np.uint64) != 0)
    at = np.flatnonzero(flags[:some].reshape(-1, 8)[words])
    return np.append(words[at // 8] * 8 + at % 8, some + np.flatnonzero(flags[some:]))


def _padded(values: np.ndarray, before: int, after: int, by: float) -> np.ndarray:
    return np.pad(values, [(before, after)] + [(0, 0)] * (values.ndim - 1), constant_values=by)


class Quick:
    """Finds the pairs of windows of ``a`` and ``b`` that may be near, by products in single precision.

    ``many`` neighbouring windows have a core of frames in common. The distance of two cores bounds all pairs of their
    windows that lie equally far in: a cell. One product bounds a cell; where it lets the cell pass, the frames
    beside the cores are added for each of its pairs.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, m: int) -> None:
        self.m, self.many = m, max(1, m // _CORES)
        ends = self.many - 1
        self.core = m - ends
        self.lost_a, self.lost_b = (~np.isfinite(f).all(axis=1) for f in (a, b))
        there = a[~self.lost_a]
        middle = there.mean(axis=0) if len(there) else np.zeros(a.shape[1])
        self.a, self.b = (np.where(lost[:, None], 0.0, f - middle) for f, lost in ((a, self.lost_a), (b, self.lost_b)))
        most = max(np.abs(self.a).max(), np.abs(self.b).max())
        self.fits = 1e-12 < most < 1e12  # squares are neither lost nor too large
        # single precision: rounded inputs, products and sums
        self.share = 2.0**-24 * 4 * (m * a.shape[1] + 16)
        self.whole_a, self.whole_b = _runs(a, m), _runs(b, m)
        # what lies beside the cores; outside of the frames nothing is near
        if ends:
            self.beside_a, self.beside_b = _runs(_padded(a, 0, ends, np.nan), ends), _runs(_padded(b, ends, ends, np.nan), ends)
        self.held = [np.empty(0, dtype=kind) for kind in (np.float32, bool, bool)]

    def without_frames(self) -> tuple[np.ndarray, np.ndarray]:
        """Which windows hold a missing or non-finite frame, and so are near to nothing."""
        return tuple(
            np.lib.stride_tricks.sliding_window_view(lost, self.m).any(axis=1) if lost.any() else np.zeros(len(lost) - self.m + 1, dtype=bool)
            for lost in (self.lost_a, self.lost_b)
        )

    def _cores(self, frames: np.ndarray, lost: np.ndarray, lo: int, hi: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Cores that begin at ``lo`` and each ``step`` after it, and their squares."""
        stop = hi + self.core - 1
        some = np.lib.stride_tricks.sliding_window_view(frames[lo:stop], self.core, axis=0)[::step].reshape(-1, self.core * frames.shape[1])
        squares = np.einsum("ij,ij->i", some, some)
        if lost[lo:stop].any():
            squares[np.lib.stride_tricks.sliding_window_view(lost[lo:stop], self.core)[::step].any(axis=1)] = _FAR
        return some, squares

    def columns(self, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """The cores of windows of ``b`` and their squares, as products take them."""
        some, squares = self._cores(self.b, self.lost_b, left, right + self.many - 1, 1)
        return np.vstack([some.T, np.ones(len(some)), squares]).astype(np.float32), squares

    def pairs(
        self, lo: int, hi: int, left: int, columns: tuple[np.ndarray, np.ndarray], near_a: np.ndarray, near_b: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray] | None:
        """``(x, y)``: the pairs that may be nearer than what is known of either window; None where cells are too many."""
        many, (right, later) = self.many, columns
        some, squares = self._cores(self.a, self.lost_a, lo + many - 1, hi + many - 1, many)
        d, found, more = self._work((len(some), right.shape[1]))
        np.matmul(np.column_stack([-2 * some, squares, np.ones(len(some))]).astype(np.float32), right, out=d)
        # nothing is nearer than 0
        near_a, near_b = (np.where(near > 0, near, -np.inf) for near in (near_a, near_b))
        near_a = _padded(near_a, 0, -len(near_a) % many, -np.inf).reshape(-1, many)
        near_b = np.lib.stride_tricks.sliding_window_view(_padded(near_b, many - 1, many - 1, -np.inf), many)
        loss_a, loss_b = (self.share * np.where(s < _FAR, s, 0.0) + _LOST for s in (squares, later))
        rows, cols = near_a.max(axis=1) + loss_a + loss_b.max(), near_b[:, 0].copy()
        for k in range(1, many):
            np.maximum(cols, near_b[:, k], out=cols)
        cols += loss_b + loss_a.max()
        up = np.float32(np.inf)
        np.less(d, np.nextafter(rows.astype(np.float32), up)[:, None], out=found)
        np.less(d, np.nextafter(cols.astype(np.float32), up), out=more)
        np.logical_or(found, more, out=found)
        if np.count_nonzero(found) > min(_NEAR_SHARE * many, _MOST_SHARE) * found.size:
            return None
        cell = _true(found.ravel())
        x, y = cell // found.shape[1], cell % found.shape[1]
        bound = np.repeat(d.ravel()[cell].astype(float)[None] - loss_a[x] - loss_b[y], many, axis=0)
        near_a, near_b = near_a[x].T, near_b[y].T
        x, y = lo + x * many, left + y
        if many > 1:
            before = _squares(self.beside_a, self.beside_b, x, y)
            after = _squares(self.beside_a, self.beside_b, x + self.m, y + self.m)
            for t in range(many - 1):
                bound[many - 2 - t] = bound[many - 1 - t] + before[many - 2 - t]
            for t in range(1, many):
                after[t - 1] += after[t - 2] if t > 1 else 0.0
                bound[t] += after[t - 1]
        t, pair = np.nonzero((bound <= near_a) | (bound <= near_b))
        return x[pair] + t, y[pair] + t - (many - 1)

    def _work(self, shape: tuple[int, int]) -> list[np.ndarray]:
        """Work arrays that are used again, good until the next call."""
        size = shape[0] * shape[1]
        if self.held[0].size < size:
            self.held = [np.empty(size, dtype=h.dtype) for h in self.held]
        return [h[:size].reshape(shape) for h in self.held]


def _take(near: np.ndarray, at: np.ndarray, i: np.ndarray, d: np.ndarray, j: np.ndarray) -> None:
    """Take the pairs ``(i, j)`` that beat ``near``, the first one on ties."""
    some = np.flatnonzero(d < near[i])
    i, d, j = i[some], d[some], j[some]
    order = np.lexsort((j, d, i))
    i, d, j = i[order], d[order], j[order]
    best = np.ones(len(i), dtype=bool)
    best[1:] = i[1:] != i[:-1]
    near[i[best]], at[i[best]] = d[best], j[best]


def _meet(
    a: np.ndarray, b: np.ndarray, m: int, gap: int, zone: int, best_a: tuple, best_b: tuple, first_a: int = 0, first_b: int = 0
) -> None:
    """Take the pairs of a window of ``a`` and one of ``b`` that beat what is known of either.

    Windows are numbered from ``first_a`` and ``first_b``. Where something is known of all windows of a piece,
    distances are summed up for the cells alone that a lower bound lets pass.
    """
    (near_a, at_a), (near_b, at_b) = best_a, best_b
    rows, cols = len(near_a), len(near_b)
    whole = _whole(a, b)
    height, width = _piece(m)
    quick = Quick(a, b, m) if m * a.shape[1] <= MOST_QUICK else None
    tall, wide = height, width
    if quick and quick.fits:
        tall, wide = _TALL * quick.many, _QUICK - quick.many + 1
        gone_a, gone_b = quick.without_frames()
    else:
        quick = None
    for start in range(0, cols, wide):
        stop = min(start + wide, cols)
        columns = None
        for lo in range(0, rows, tall):
            hi = min(lo + tall, rows)
            if quick:
                known_a, known_b = (np.where(g, 0.0, n) for g, n in ((gone_a[lo:hi], near_a[lo:hi]), (gone_b[start:stop], near_b[start:stop])))
                if not known_a.any() and not known_b.any():
                    continue
                if np.isfinite(known_a).all() and np.isfinite(known_b).all():
                    columns = columns or quick.columns(start, stop)
                    pairs = quick.pairs(lo, hi, start, columns, known_a, known_b)
                    if pairs is not None:
                        x, y = pairs
                        some = np.flatnonzero((x < rows) & (y >= start) & (y < stop) & (np.abs(gap + y - x) > zone))
                        x, y = x[some], y[some]
                        d = pair_distances(quick.whole_a, quick.whole_b, m, x, y)
                        _take(near_a, at_a, x, d, y + first_b)
                        _take(near_b, at_b, y, d, x + first_a)
                        continue
            for low in range(lo, hi, height):
                high = min(low + height, hi)
                for left in range(start, stop, width):
                    right = min(left + width, stop)
                    d = window_distances(a[low : high + m - 1], b[left : right + m - 1], m)
                    if not whole:
                        _finite(d)
                    _hide(d, gap + left - low, zone)
                    _improve_rows(near_a[low:high], at_a[low:high], d, left + first_b)
                    _improve_cols(near_b[left:right], at_b[left:right], d, low + first_a)


def nearest_between(
    a: np.ndarray, b: np.ndarray, m: int, gap: int, zone: int
) -> tuple[np.ndarray, ...]:
    """Nearest window of ``b`` for each of ``a`` and the other way round.

    ``b`` starts ``gap`` after ``a``; pairs at most ``zone`` apart do not count.
    """
    best_a, best_b = _none_yet(len(a) - m + 1), _none_yet(len(b) - m + 1)
    _meet(a, b, m, gap, zone, best_a, best_b)
    return *best_a, *best_b


def _meet_itself(a: np.ndarray, m: int, zone: int, near: np.ndarray, at: np.ndarray, first: int) -> None:
    """Take the pairs of windows of ``a`` that beat what is known of either; windows are numbered from ``first``.

    Distances are symmetric: a row range only looks at windows from its own start
    on, and serves the later ones as well.
    """
    n = len(near)
    whole = _whole(a)
    height, width = _piece(m)
    for lo in range(0, n, height):
        hi = min(lo + height, n)
        for left in range(lo, n, width):
            right = min(left + width, n)
            d = window_distances(a[lo : hi + m - 1], a[left : right + m - 1], m)
            if not whole:
                _finite(d)
            _hide(d, left - lo, zone)
            _improve_rows(near[lo:hi], at[lo:hi], d, left + first)
            # the square on the diagonal has served its own rows already
            later = max(left, hi)
            _improve_cols(near[later:right], at[later:right], d[:, later - left :], lo + first)


def nearest_within(a: np.ndarray, m: int, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest other window of ``a`` more than ``zone`` windows away: squares on the diagonal, then all after them."""
    n = len(a) - m + 1
    near, at = _none_yet(n)
    hi = 0
    while hi < n:
        # the first ones are compared with all others before anything is known
        lo, hi = hi, min(hi + (_QUICK if hi else _FIRST), n)
        _meet_itself(a[lo : hi + m - 1], m, zone, near[lo:hi], at[lo:hi], lo)
        if hi < n:
            _meet(a[lo : hi + m - 1], a[hi:], m, hi - lo, zone, (near[lo:hi], at[lo:hi]), (near[hi:], at[hi:]), lo, hi)
    return near, at


def _matrix(column) -> np.ndarray:
    """One list of frame vectors as a matrix."""
    frames = column.values
    numbers = frames.flatten().to_numpy(zero_copy_only=False)
    if not frames.null_count:
        return numbers.reshape(len(frames), -1)
    there = frames.is_valid().to_numpy(zero_copy_only=False)
    out = np.full((len(frames), len(numbers) // max(1, int(there.sum())) or 1), np.nan)
    if there.any():
        out[there] = numbers.reshape(int(there.sum()), -1)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as bytes; one without any whole frame has one number a frame."""
    for batch in batches:
        at, held, dims, size = 0, [], [], 0
        for row in range(batch.num_rows):
            some = _matrix(batch.column("_f")[row])
            held.append(some.tobytes())
            dims.append(some.shape[1])
            size += some.nbytes
            if size > 8 * _CELLS or row + 1 == batch.num_rows:
                keys = batch.select(["track", "blk"]).slice(at, len(held))
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, pa.array(held, pa.binary()), pa.array(dims, pa.int32())],
                    names=["track", "blk", "frames", "dims"],
                )
                at, held, dims, size = row + 1, [], [], 0


def _unpacked(data: pa.Buffer, own: int, dims: int) -> np.ndarray:
    """A block's frames, in as many numbers as the blocks it meets."""
    frames = np.frombuffer(data).reshape(-1, own)
    return frames if own == dims else np.full((len(frames), dims), np.nan)


def _stack(column, length: int) -> np.ndarray:
    """Lists of equally many frame vectors as a stack of matrices; a missing frame is not a number."""
    frames = column.flatten()
    numbers = frames.flatten().to_numpy(zero_copy_only=False)
    if frames.null_count:
        there = frames.is_valid().to_numpy(zero_copy_only=False)
        whole = np.full((len(frames), len(numbers) // max(1, int(there.sum())) or 1), np.nan)
        if there.any():
            whole[there] = numbers.reshape(int(there.sum()), -1)
        numbers = whole
    return numbers.reshape(len(column), length, -1)


def _as_vector(frames: DataFrame, value: str) -> DataFrame:
    kind = frames.schema[value].dataType.simpleString()
    vector = F.col(value) if kind.startswith("array") else F.array(F.col(value).cast("double"))
    return frames.select("track", "pos", vector.cast("array<double>").alias("_f"))


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is heavy in computing but not in bytes.

    A fixed number of partitions is not merged at run time.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(wanted, 2 * spark.sparkContext.defaultParallelism)


def _parts_of(df: DataFrame) -> int:
    """Blocks of a long track, so that their pairs are three for each core."""
    return math.isqrt(6 * df.sparkSession.sparkContext.defaultParallelism) + 1


def matrix_profile(
    frames: DataFrame, m: int, value: str = "value", block: int | None = None
) -> DataFrame:
    """``(track, i, mp, pi)`` for every subsequence of ``m`` frames.

    ``mp`` is the Euclidean distance to the nearest subsequence of the same
    track more than ``m / 2`` frames away and ``pi`` its position, the first one
    on ties; without any such subsequence they are infinite and -1. ``value`` is
    a number or a vector of numbers per frame; positions count 0, 1, 2, ... without
    gaps. Each block is first compared with itself and then sent once for every other block of its track, with
    what it knows: blocks of long tracks grow beyond ``block``, so
    that what is sent grows with the track and not with its square.
    """
    if block is None:
        block = max(BLOCK, 2 * m)
    if block < m:
        raise ValueError("block must hold at least one window")
    vectors = _as_vector(frames, value)
    longest = frames.agg(F.max("pos")).first()[0] or 0
    block = max(block, min(MOST_BLOCK, longest // _parts_of(frames) + 1))
    own = F.expr(f"pos div {block}")
    spill = (F.col("pos") % block < m - 1) & (own > 0)
    blocks = (
        vectors.withColumn("blk", F.explode(F.when(spill, F.array(own, own - 1)).otherwise(F.array(own))))
        .groupBy("track", "blk")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "_f"))).alias("_s"))
        .select("track", "blk", F.transform("_s", lambda s: s["_f"]).alias("_f"))
    )
    kind = vectors.schema["track"].dataType.simpleString()
    blocks = blocks.mapInArrow(_packed, f"track {kind}, blk bigint, frames binary, dims int")
    sizes = frames.groupBy("track").agg(
        F.expr(f"(max(pos) + 1 - {m}) div {block}").alias("last_blk"),
        (F.max("pos") + 1 - m).alias("last_i"),
    ).where("last_i >= 0").drop("last_i")
    blocks = blocks.join(sizes, "track").where("blk <= last_blk")
    zone = m // 2
    near = f"track {kind}, i bigint, d2 double, j bigint"

    def rows_of(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        rows, *rest = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([batch.column("track").take(pa.array(rows)), *map(pa.array, rest)], names=["track", "i", "d2", "j"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """``(batch, row, d2, j, last)`` of each block."""
        for batch in batches:
            for row, (data, dims) in enumerate(zip(batch.column("frames"), batch.column("dims").to_pylist())):
                d2, j = nearest_within(_unpacked(data.as_buffer(), dims, dims), m, zone)
                yield batch, row, d2, j, row == batch.num_rows - 1

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = [], 0
        for batch, row, d2, j, last in within(batches):
            first = batch.column("blk")[row].as_py() * block
            found.append((np.full(len(d2), row), np.arange(len(d2)) + first, d2, np.where(np.isfinite(d2), j + first, -1)))
            waiting += len(d2)
            if waiting > _CELLS or last:
                yield rows_of(batch, found)
                found, waiting = [], 0

    # one block a track
    if longest < block:
        own = blocks.repartition(_tasks(blocks), "track")
        partial = own.mapInArrow(alone, near)
        return _profile(partial)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, d2, j, _ in within(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(row, 1).columns, *(pa.array([x.tobytes()], pa.binary()) for x in (d2, j, _above(d2)))],
                names=[*batch.schema.names, "d2", "j", "bound"],
            )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, blk in enumerate(batch.column("blk").to_pylist()):
                d2, j = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=t) for c, t in (("d2", np.float64), ("j", np.int64)))
                i = np.arange(len(d2)) + blk * block
                yield rows_of(batch, [(np.full(len(i), row), i, d2, np.where(np.isfinite(d2), j + blk * block, -1))])

    # what a block knows of itself rules out most windows of the others
    # blocks that take seconds are dealt over more tasks, so that few have to wait for several
    many = (4 if block < _HEAVY else 16) * max(frames.sparkSession.sparkContext.defaultParallelism * 2, 8)
    inside = blocks.select("track", "blk", "frames", "dims", "last_blk").repartition(many, "track", "blk")
    inside = cut_lineage(
        inside.mapInArrow(known, f"track {kind}, blk bigint, frames binary, dims int, last_blk bigint, d2 binary, j binary, bound binary")
    )
    sides = (
        inside.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last_blk")))
        .where("other != blk")
        .select("track", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "blk", "frames", "dims", "bound")
    )
    # one row per tile, with its two blocks in order
    tiles = (
        sides.repartition(max(_tasks(sides), many), "track", "a", "b")
        .groupBy("track", "a", "b")
        .agg(F.array_sort(F.collect_list(F.struct("blk", "frames", "dims", "bound"))).alias("_p"))
        .select("track", "a", "b", *(F.col("_p")[c].alias(c) for c in ("frames", "dims", "bound")))
    )

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = np.stack([batch.column(c).to_numpy() * block for c in "ab"], axis=1)
            for row, (a, b) in enumerate(starts):
                dims = batch.column("dims")[row].as_py()
                parts = [_unpacked(f.as_buffer(), k, max(dims)) for f, k in zip(batch.column("frames")[row].values, dims)]
                best = [np.frombuffer(f.as_buffer(), dtype=np.float32).astype(float) for f in batch.column("bound")[row].values]
                best = [(d2, np.full(len(d2), -1, dtype=np.int64)) for d2 in best]
                _meet(*parts, m, b - a, zone, *best)
                # windows that found nothing nearer in the other block have their row already
                for (d2, j), first, other in zip(best, (a, b), (b, a)):
                    i = np.flatnonzero(j >= 0)
                    if len(i):
                        yield rows_of(batch, [(np.full(len(i), row), i + first, d2[i], j[i] + other)])

    return _profile(inside.mapInArrow(opened, near).unionByName(tiles.mapInArrow(between, near)))


def _above(d2: np.ndarray) -> np.ndarray:
    """Bounds in single precision that are above the distances, so that equally near windows are below them."""
    with np.errstate(over="ignore"):
        return np.nextafter(d2.astype(np.float32), np.float32(np.inf))


def _profile(partial: DataFrame) -> DataFrame:
    """The nearest of what tiles found, the first one on ties."""
    best = partial.groupBy("track", "i").agg(F.min(F.struct("d2", "j")).alias("_best"))
    return best.select(
        "track", "i", F.sqrt("_best.d2").alias("mp"), F.col("_best.j").alias("pi")
    )


def nearest_of(q: np.ndarray, r: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest window of ``r`` for each window of ``q``: infinite and -1 where there is none.

    Rectangles of the two are gone over one after the other; no whole distance block is held.
    """
    rows, cols = len(q) - m + 1, len(r) - m + 1
    near, at = _none_yet(rows)
    whole = _whole(q, r)
    height, width = _piece(m)
    for lo in range(0, rows, height):
        hi = min(lo + height, rows)
        for left in range(0, cols, width):
            right = min(left + width, cols)
            d = window_distances(q[lo : hi + m - 1], r[left : right + m - 1], m)
            if not whole:
                _finite(d)
            _improve_rows(near[lo:hi], at[lo:hi], d, left)
    return np.sqrt(near), at


def _matched(
    q: np.ndarray, r: np.ndarray, m: int
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest window of ``r`` for each window of ``q``, for stacks of both; ``r`` may be one for all."""
    if q.shape[2] != r.shape[2]:
        # frames of other dimensions, or none at all, are near to nothing
        rows = q.shape[1] - m + 1
        return np.full((len(q), rows), np.inf), np.full((len(q), rows), -1, dtype=np.int64)
    if q.shape[1] * r.shape[1] > _CELLS:
        each = [nearest_of(q[k], r[k if len(r) > 1 else 0], m) for k in range(len(q))]
        return np.stack([n for n, _ in each]), np.stack([a for _, a in each])
    part = np.zeros((q.shape[0], q.shape[1], r.shape[1]))
    for k in range(q.shape[2]):
        part += np.square(q[:, :, None, k] - r[:, None, :, k])
    d = diagonal_sums(part, m)
    if not _whole(q, r):
        _finite(d)
    near, at = np.sqrt(d.min(axis=2)), d.argmin(axis=2)
    return near, np.where(np.isfinite(near), at, -1)


def _profile_rows(near: np.ndarray, at: np.ndarray) -> tuple[int, list[np.ndarray]]:
    rows, width = near.shape
    return width, [np.tile(np.arange(width), rows), near.ravel(), at.ravel()]


def _feature_rows(near: np.ndarray, at: np.ndarray) -> tuple[int, list]:
    """Minimum, median and maximum of what has a neighbour; null where nothing has one."""
    with_one = np.where(np.isfinite(near), near, np.nan)
    none = np.isnan(with_one).all(axis=1)
    with_one[none] = 0.0
    found = [np.nanmin(with_one, axis=1), np.nanmedian(with_one, axis=1), np.nanmax(with_one, axis=1)]
    return 1, [pa.array(x, mask=none) for x in found]


def _blocks_of(windows: DataFrame, keys: list[str], m: int, block: int) -> DataFrame:
    """``(keys, _from, _n, q_frames)``: windows in blocks of ``block`` subsequences, and how many there are."""
    subsequences = F.size("q_frames") - m + 1
    starts = F.when(subsequences > block, F.sequence(F.lit(0), subsequences - 1, F.lit(block))).otherwise(F.array(F.lit(0)))
    rows = windows.select(*keys, "q_frames", F.size(starts).alias("_n"), F.explode(starts).alias("_from"))
    part = F.when(F.col("_n") > 1, F.slice("q_frames", F.col("_from") + 1, F.lit(block + m - 1))).otherwise(F.col("q_frames"))
    return rows.select(*keys, F.col("_from").cast("bigint"), "_n", part.alias("q_frames"))


def _against_references(windows, references, m, keys, ref, shape, fields, max_references):
    """Rows made by ``shape`` out of the profile of every window and reference."""
    names = [f.split()[0] for f in fields]
    ref_type = references.schema[ref].dataType.simpleString()
    schema = ", ".join(
        [f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys] + [f"{ref} {ref_type}", *fields]
    )
    # what is sent to the tasks is counted before
    sizes = references.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.flatten("r_frames"))), F.lit(0)).alias("numbers")).first()
    sent = sizes["n"] <= max_references and sizes["numbers"] <= MOST_SENT

    def rows_of(batch, some, near, at, labels):
        repeat, columns = shape(near, at)
        picked = batch.select(keys).take(pa.array(np.repeat(some, repeat)))
        return pa.RecordBatch.from_arrays(
            [*picked.columns, labels.take(pa.array(np.repeat(np.arange(len(labels)), repeat))), *map(pa.array, columns)],
            names=[*keys, ref, *names],
        )

    def parts(lists: np.ndarray, other: int):
        """Rows of equal sizes, a bounded number at a time."""
        for size in np.unique(lists, axis=0):
            if np.nanmin(size) >= m and not np.isnan(size).any():
                rows = np.flatnonzero((lists == size).all(axis=1))
                step = max(1, int(_CELLS // (size[0] * (other or size[1]))))
                yield from ((some, size) for some in np.split(rows, range(step, len(rows), step)))

    if sent:
        known = []
        for batch in references.select(ref, "r_frames").toArrow().combine_chunks().to_batches():
            known += [(batch.column(ref)[k].as_py(), _matrix(f)) for k, f in enumerate(batch.column("r_frames")) if f.is_valid]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                queries = batch.column("q_frames")
                lists = pc.list_value_length(queries).to_numpy(zero_copy_only=False)[:, None].astype(float)
                for name, frames in known:
                    if len(frames) < m:
                        continue
                    for some, size in parts(lists, len(frames)):
                        q = _stack(queries.take(pa.array(some)), int(size[0]))
                        near, at = _matched(q, frames[None], m)
                        yield rows_of(batch, some, near, at, pa.array([name] * len(some)))

        return windows.select(*keys, "q_frames").mapInArrow(run, schema)

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, refs = batch.column("q_frames"), batch.column("r_frames")
            lists = np.stack([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in (queries, refs)], axis=1).astype(float)
            for some, size in parts(lists, 0):
                q = _stack(queries.take(pa.array(some)), int(size[0]))
                r = _stack(refs.take(pa.array(some)), int(size[1]))
                near, at = _matched(q, r, m)
                yield rows_of(batch, some, near, at, batch.column(ref).take(pa.array(some)))

    pairs = with_each(windows.select(*keys, "q_frames"), references.select(ref, "r_frames"), by=keys)
    return pairs.mapInArrow(run_pairs, schema)


def reference_profile(
    windows: DataFrame,
    references: DataFrame,
    m: int,
    keys: list[str],
    ref: str = "ref",
    max_references: int = 1000,
) -> DataFrame:
    """``(keys, ref, i, mp, pi)``: profiles of windows against references.

    ``windows`` holds ``keys`` and ``q_frames``, ``references`` holds ``ref`` and
    ``r_frames``, both arrays of frame vectors. For every subsequence of a window
    the nearest one of the reference is found, without exclusion zone. A missing or non-finite
    frame takes out the subsequences it is in; one without any neighbour has distance infinity and
    position -1. Long windows are cut in blocks of ``BLOCK`` subsequences, each a row of its own, and a
    task goes over rectangles of a block and a reference. Up to ``max_references`` references of at most
    ``MOST_SENT`` numbers are a model that goes to the tasks; more of them
    stay a table that the windows are joined with.
    """
    fields = ["i bigint", "mp double", "pi bigint"]
    blocks = _blocks_of(windows, keys, m, BLOCK)
    rows = _against_references(blocks, references, m, [*keys, "_from"], ref, _profile_rows, fields, max_references)
    return rows.select(*keys, ref, (F.col("i") + F.col("_from")).alias("i"), "mp", "pi")


def reference_features(
    windows: DataFrame,
    references: DataFrame,
    m: int,
    keys: list[str],
    ref: str = "ref",
    max_references: int = 1000,
) -> DataFrame:
    """``(keys, ref, mp_min, mp_median, mp_max)``: the same profiles summed up.

    Only subsequences with a neighbour count; without any the three are null. The profile of a window of one block never
    leaves its task; blocks of longer windows are summed up together by a grouping.
    """
    fields = ["mp_min double", "mp_median double", "mp_max double"]
    blocks = _blocks_of(windows, keys, m, BLOCK)
    short = _against_references(blocks.where("_n = 1"), references, m, keys, ref, _feature_rows, fields, max_references)
    rows = ["i bigint", "mp double", "pi bigint"]
    long = _against_references(blocks.where("_n > 1"), references, m, [*keys, "_from"], ref, _profile_rows, rows, max_references)
    near = F.when(F.col("pi") >= 0, F.col("mp"))
    summed = long.groupBy(*keys, ref).agg(F.min(near).alias("mp_min"), F.median(near).alias("mp_median"), F.max(near).alias("mp_max"))
    return short.unionByName(summed)


def motifs(profile: DataFrame) -> DataFrame:
    """``(track, motif_0, motif_1, discord_0, discord_1)`` of every profile.

    The motif is the closest pair, the discord the subsequence farthest from its
    nearest neighbour; the first position wins ties.
    """
    nearest = F.min(F.struct("mp", "i", "pi"))
    farthest = F.min(F.struct((-F.col("mp")).alias("far"), "i", "pi"))
    return (
        profile.where("pi >= 0")
        .groupBy("track")
        .agg(nearest.alias("_m"), farthest.alias("_d"))
        .select(
            "track",
            F.col("_m.i").alias("motif_0"),
            F.col("_m.pi").alias("motif_1"),
            F.col("_d.i").alias("discord_0"),
            F.col("_d.pi").alias("discord_1"),
        )
    )


def top_positions(profile: DataFrame, n_motif: int = 3, n_discord: int = 1) -> DataFrame:
    """``(track, idx)``: the distinct places of the best motifs and discords.

    The ``n_motif`` smallest and ``n_discord`` largest profile values of a track,
    each with its nearest neighbour.
    """
    usable = profile.where("pi >= 0")
    low = Window.partitionBy("track").orderBy("mp", "i")
    high = Window.partitionBy("track").orderBy(F.desc("mp"), F.desc("i"))
    best = usable.withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= n_motif)
    worst = usable.withColumn("_r", F.row_number().over(high)).where(F.col("_r") <= n_discord)
    return (
        best.unionByName(worst)
        .select("track", F.explode(F.array("i", "pi")).alias("idx"))
        .distinct()
    )
