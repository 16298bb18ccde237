"""Recordings that arrive in parts: windows and pairs formed out of keyed state.

Parts of a recording come in the order of time, spread over files. What the next part needs
is kept per key by Spark's state store, so a restarted query goes on where it was, and a
recording that has ended leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackweave.operators.windows import PADDINGS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHUNK = 64  # windows of a track that are kept in one row of its state
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state of any shape needs, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def write_in_order(rows: DataFrame, path: str, order: str, files: int) -> None:
    """``rows`` in about ``files`` files that arrive in the order of a column.

    Rows of one value are in one file. A stream reads files by their time, so the times follow the file names.
    """
    rows.repartitionByRange(files, order).write.parquet(path)
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")]
    last = max((f.getModificationTime() for f in found), default=0)
    names = sorted((f.getPath() for f in found), key=lambda p: p.getName())
    for i, name in enumerate(names):
        system.setTimes(name, last - 1000 * (len(names) - i), -1)


class WindowCutter(StatefulProcessor):
    """Cuts a recording in windows as its parts arrive.

    Input ``(track, ts, pos, value)``, output ``(track, win_idx, start_pos, x)``. Kept are the samples
    from the start of the next window on, and the last step, never the recording. A timer
    ``gap_ms`` after the last sample closes it: the padded last windows are given and the state is cleared.
    Samples wait for the ones before them; those that have not come by then (or came later than the
    watermark allows) are zeros.
    """

    SCHEMA = "track bigint, win_idx bigint, start_pos bigint, x array<double>"

    def __init__(self, width: int, step: int | None = None, padding: str = "right", gap_ms: int = 60_000):
        if padding not in PADDINGS or padding == "center":
            raise ValueError("the padding of a running recording is right or right-align")
        self.width, self.step, self.padding, self.gap = width, step or width, padding, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # base: position of the first kept sample; early: samples beyond a gap, with their positions
        self.kept = handle.getValueState("kept", "base bigint, nxt bigint, last bigint, vals array<double>, at array<bigint>, early array<double>")

    def _load(self) -> tuple[int, int, int | None, np.ndarray, dict[int, float]]:
        kept = self.kept.get()
        if kept is None:
            return 0, 0, None, np.zeros(0), {}
        base, nxt, last, values, at, early = kept
        return base, nxt, last, np.array(values, dtype=float), dict(zip(at, early))

    def _windows(self, key: int, base: int, nxt: int, values: np.ndarray, end: int) -> tuple[list, int]:
        """The windows up to a position, and the number of the one after them."""
        rows = []
        while nxt * self.step + self.width <= end:
            lo = nxt * self.step - base
            rows.append((key, nxt, nxt * self.step, values[lo : lo + self.width].tolist()))
            nxt += 1
        return rows, nxt

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["track", "win_idx", "start_pos", "x"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base, nxt, before, values, early = self._load()
        last = before or 0
        for part in rows:
            last = max(last, int(part["ts"].max().value // 1_000_000))
            early.update(zip(part["pos"].astype(int), part["value"].astype(float)))
        end, more = base + len(values), []
        while end + len(more) in early:
            more.append(early.pop(end + len(more)))
        values = np.concatenate([values, more])
        n = base + len(values)
        # from the right end, what follows the last whole step is not known before the end
        found, nxt = self._windows(int(key[0]), base, nxt, values, n if self.padding == "right" else n - n % self.step)
        # the next window and, for a padding from the right end, the last step
        first = max(base, min(nxt * self.step, n - self.step))
        values, base = values[first - base :], first
        self.kept.update((base, nxt, last, values.tolist(), list(early), list(early.values())))
        if last != before:
            # the one timer of a recording stands where its last sample set it
            if before is not None:
                self.handle.deleteTimer(before + self.gap)
            self.handle.registerTimer(last + self.gap)
        if found:
            yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        base, nxt, _, values, early = self._load()
        if early:
            # samples that never came are zeros
            missing = np.zeros(max(early) + 1 - base - len(values))
            missing[np.array(list(early)) - base - len(values)] = list(early.values())
            values = np.concatenate([values, missing])
        n = base + len(values)
        rest = n % self.step
        if rest and self.padding == "right":
            values = np.concatenate([values, np.zeros(self.step - rest)])
        elif rest:
            values = np.concatenate([values[: len(values) - rest], values[-min(n, self.step) :]])
        found, _ = self._windows(int(key[0]), base, nxt, values, base + len(values))
        self.kept.clear()
        if found:
            yield self._frame(found)

    def close(self) -> None:
        pass


def arriving_windows(stream: DataFrame, delay: str, cutter: WindowCutter) -> DataFrame:
    """``(track, win_idx, start_pos, x)`` of a stream ``(track, ts, pos, value)``."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy("track")
        .transformWithStateInPandas(cutter, cutter.SCHEMA, outputMode="Append", timeMode="EventTime")
    )


class Chunks:
    """Map state read and written in chunks of ``CHUNK`` neighbouring windows, each once for a call."""

    def __init__(self, state) -> None:
        self.state, self.held, self.changed = state, {}, set()

    def get(self, window: int) -> list[tuple]:
        """The rows of the chunk of a window."""
        chunk = window // CHUNK
        if chunk not in self.held:
            found = self.state.getValue((chunk,))
            self.held[chunk] = [] if found is None else list(zip(*found))
        return self.held[chunk]

    def put(self, window: int, rows: list[tuple]) -> None:
        self.held[window // CHUNK] = rows
        self.changed.add(window // CHUNK)

    def store(self) -> None:
        for chunk in self.changed:
            if self.held[chunk]:
                self.state.updateValue((chunk,), tuple(list(c) for c in zip(*self.held[chunk])))
            elif self.state.containsKey((chunk,)):
                self.state.removeKey((chunk,))


class PairMaker(StatefulProcessor):
    """Pairs of a window and its neighbour, formed when the later of the two arrives.

    Input ``(worker, track, slice, win_idx, total, nbr)``, grouped by worker and track; a null neighbour asks for no
    pair, a null window says that the track has ended. Kept for each open track are the windows that have arrived
    and the requests that wait, by window, in chunks of neighbouring windows. ``slice`` numbers the arrival of a
    window; a pair has the number of its later window.
    """

    SCHEMA = "worker bigint, track bigint, slice bigint, anchor_win_idx bigint, anchor_total double, neighbor_win_idx bigint, neighbor_total double"
    NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "chunk bigint", "win_idx array<bigint>, slice array<bigint>, total array<double>")
        self.waiting = handle.getMapState("waiting", "chunk bigint", "nbr array<bigint>, anchor array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        worker, track = int(key[0]), int(key[1])
        found, ended = [], False
        seen, waiting = Chunks(self.seen), Chunks(self.waiting)

        def arrived(window: int) -> tuple | None:
            return next((r for r in reversed(seen.get(window)) if r[0] == window), None)

        def pair(anchor: tuple, neighbour: tuple) -> None:
            found.append((worker, track, max(anchor[1], neighbour[1]), anchor[0], anchor[2], neighbour[0], neighbour[2]))

        for part in rows:
            for window, place, total, nbr in zip(part["win_idx"], part["slice"], part["total"], part["nbr"]):
                if pd.isna(window):
                    ended = True
                    continue
                here = (int(window), int(place), float(total))
                seen.put(here[0], [r for r in seen.get(here[0]) if r[0] != here[0]] + [here])
                held = waiting.get(here[0])
                asked = [anchor for wanted, anchor in held if wanted == here[0]]
                if asked:
                    for anchor in asked:
                        pair(arrived(anchor), here)
                    waiting.put(here[0], [r for r in held if r[0] != here[0]])
                if pd.isna(nbr):
                    continue
                other = arrived(int(nbr))
                if other is not None:
                    pair(here, other)
                else:
                    waiting.put(int(nbr), [*waiting.get(int(nbr)), (int(nbr), here[0])])
        if ended:
            self.seen.clear()
            self.waiting.clear()
        else:
            seen.store()
            waiting.store()
        if found:
            yield pd.DataFrame(found, columns=self.NAMES)

    def close(self) -> None:
        pass


class BatchMaker(StatefulProcessor):
    """Full batches of arriving pairs, up to a number of batches for each consumer.

    Input are pairs as ``PairMaker`` gives them, grouped by worker, with a ``draw`` that orders the pairs of one slice.
    Kept for each worker are the open batch and the number of batches given. A positive ``limit`` is
    what one consumer reads: so many batches, all of worker 0.
    """

    PAYLOAD = ["track", "anchor_win_idx", "anchor_total", "neighbor_win_idx", "neighbor_total"]
    SCHEMA = "worker bigint, batch bigint, slot int, track bigint, anchor_win_idx bigint, anchor_total double, neighbor_win_idx bigint, neighbor_total double"
    OPEN = "track bigint, anchor_win_idx bigint, anchor_total double, neighbor_win_idx bigint, neighbor_total double"

    def __init__(self, size: int, limit: int = -1):
        self.size, self.limit = size, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", self.OPEN)
        self.given = handle.getValueState("given", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        worker = int(key[0])
        given = self.given.get()[0] if self.given.exists() else 0
        if self.limit > 0 and (worker > 0 or given >= self.limit):
            return
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        fresh = pd.concat(parts).sort_values(["slice", "draw", "track", "anchor_win_idx"])
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        held += [tuple(r) for r in fresh[self.PAYLOAD].itertuples(index=False)]
        full = len(held) // self.size
        if self.limit > 0:
            full = min(full, self.limit - given)
        if full:
            out = pd.DataFrame(held[: full * self.size], columns=self.PAYLOAD)
            place = np.arange(len(out))
            out.insert(0, "slot", (place % self.size).astype(np.int32))
            out.insert(0, "batch", given + place // self.size)
            out.insert(0, "worker", worker)
            given, held = given + full, held[full * self.size :]
            yield out
        self.given.update((int(given),))
        if not held or (self.limit > 0 and given >= self.limit):
            self.open.clear()
        else:
            self.open.put([(int(t), int(a), float(x), int(n), float(y)) for t, a, x, n, y in held])

    def close(self) -> None:
        pass


def arriving_pairs(stream: DataFrame) -> DataFrame:
    """Pairs out of arriving windows ``(worker, track, slice, win_idx, total, nbr)``."""
    return stream.groupBy("worker", "track").transformWithStateInPandas(PairMaker(), PairMaker.SCHEMA, outputMode="Append", timeMode="None")


def arriving_batches(pairs: DataFrame, maker: BatchMaker, draw) -> DataFrame:
    """``(worker, batch, slot, track, anchor_*, neighbor_*)`` out of arriving pairs."""
    return (
        pairs.withColumn("draw", draw)
        .groupBy("worker")
        .transformWithStateInPandas(maker, maker.SCHEMA, outputMode="Append", timeMode="None")
    )
