"""Row ranges, batches and interleaved reading orders as columns."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.operators.numbering import number_shuffled, repeat_rows
from trackweave.session import cut_lineage


def chunk_no(idx: Column, size: int) -> Column:
    """Which run of ``size`` consecutive rows a row belongs to."""
    return F.floor(idx / size)


def worker_of(idx: Column, n: Column, workers: int) -> Column:
    """Contiguous ranges of ``ceil(n / workers)`` rows."""
    return F.floor(idx / F.ceil(n / workers))


def full_batches(numbered: DataFrame, size: int, idx: str = "row_idx", n: str = "n") -> DataFrame:
    """Add ``batch`` and ``slot``; rows of the incomplete last batch go.

    ``idx`` counts rows per worker and ``n`` is the worker's number of rows.
    """
    return (
        numbered.withColumn("batch", F.floor(F.col(idx) / size))
        .withColumn("slot", F.pmod(F.col(idx), F.lit(size)).cast("int"))
        .where(F.col("batch") < F.floor(F.col(n) / size))
    )


def interleave(windows: DataFrame, queue: int, seed, noise: str = "noise") -> DataFrame:
    """``(wave, round, slot, track, win_idx, label)``: a mixed reading order.

    ``windows`` has ``track, win_idx, label``. Tracks are read ``queue - 1`` at a
    time; every round takes one random window of each and, first of all, one
    noise row, which is also read in the round that finds the tracks at an end.
    Sorting by ``wave, round, slot`` gives the order.
    """
    # read several times below; the windows may be costly to make
    windows = cut_lineage(windows.select("track", "win_idx", "label"))
    tracks = number_shuffled(windows.select("track").distinct(), [], seed, ["track"], "_t")
    places = tracks.select(
        "track",
        F.floor(F.col("_t") / (queue - 1)).alias("wave"),
        (F.pmod(F.col("_t"), F.lit(queue - 1)) + 1).cast("int").alias("slot"),
    )
    rounds = number_shuffled(windows, ["track"], seed, ["track", "win_idx"], "round")
    data = rounds.join(places, "track").select(
        "wave", "round", "slot", "track", "win_idx", "label"
    )
    seen = data.groupBy("wave", "round").agg(F.count(F.lit(1)).alias("_n"))
    last = seen.groupBy("wave").agg((F.max("round") + 1).alias("round"))
    empty = F.lit(None).cast("bigint")
    extra = (
        seen.select("wave", "round")
        .unionByName(last)
        .select(
            "wave",
            "round",
            F.lit(0).alias("slot"),
            empty.cast(data.schema["track"].dataType).alias("track"),
            empty.alias("win_idx"),
            F.lit(noise).alias("label"),
        )
    )
    return data.unionByName(extra)


def _started(queue: int):
    """The round in which every track of a worker is opened; tracks come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, free = None, []
        for batch in batches:
            starts = []
            for w, n in zip(batch.column("worker").to_pylist(), batch.column("n").to_pylist()):
                if w != worker:
                    worker, free = w, [0] * (queue - 1)
                # the slot that is free first; the round after the last window finds the track at its end
                starts.append(free[0])
                heapq.heapreplace(free, free[0] + n + 1)
            columns = [batch.column(c) for c in ("worker", "seq", "track", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int64())], names=["worker", "seq", "track", "n", "start"])

    return run


def refilled_queue(windows: DataFrame, queue: int, workers: int, seed, noise: str = "noise") -> DataFrame:
    """``(worker, round, slot, track, win_idx, label)``: the order in which workers read their tracks.

    ``windows`` has ``track, win_idx, label``. Tracks are shuffled and dealt to workers in contiguous
    ranges. A worker has ``queue - 1`` tracks open beside the noise; each round takes one random
    window of every open track. The round in which a track is found at its end takes none of it,
    and in the next one the first track that is not yet read has its place. Every round begins with a noise row.

    When tracks start depends on the lengths of all tracks before them in the worker's range: a task
    goes over one row for each track, in order, and carries the ends of the open ones.
    """
    if queue < 2:
        raise ValueError("the queue needs a place beside the noise")
    windows = cut_lineage(windows.select("track", "win_idx", "label"))
    sizes = windows.groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    tracks = number_shuffled(sizes, [], seed, ["track"], "seq", "_all")
    tracks = tracks.withColumn("worker", worker_of(F.col("seq"), F.col("_all"), workers)).select("worker", "seq", "track", "n")
    kind = windows.schema["track"].dataType.simpleString()
    dealt = tracks.repartition("worker").sortWithinPartitions("worker", "seq")
    started = cut_lineage(dealt.mapInArrow(_started(queue), f"worker bigint, seq bigint, track {kind}, n bigint, start bigint"))

    order = number_shuffled(windows, ["track"], seed, ["track", "win_idx"], "_at")
    # the queue bounds the rows of a round
    place = Window.partitionBy("worker", "round").orderBy("seq")
    data = (
        order.join(started, "track")
        .withColumn("round", F.col("start") + F.col("_at"))
        .withColumn("slot", F.row_number().over(place))
        .select("worker", "round", "slot", "track", "win_idx", "label")
    )
    ends = started.groupBy("worker").agg((F.max(F.col("start") + F.col("n")) + 1).alias("_rounds"))
    empty = F.lit(None)
    first = repeat_rows(ends, F.col("_rounds"), "round").select(
        "worker",
        "round",
        F.lit(0).alias("slot"),
        empty.cast(kind).alias("track"),
        empty.cast(windows.schema["win_idx"].dataType).alias("win_idx"),
        F.lit(noise).alias("label"),
    )
    return data.unionByName(first)
