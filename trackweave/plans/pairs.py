"""The pair stream: profiles to window pairs, batches and triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackweave.operators.batches import full_batches, worker_of
from trackweave.operators.numbering import number_shuffled
from trackweave.operators.pairing import batch_distants, neighbour_pairs, window_neighbours
from trackweave.session import cut_lineage


def pair_batches(
    profile: DataFrame, windows: DataFrame, width: int, workers: int, size: int, seed
) -> DataFrame:
    """``(worker, batch, slot, track, anchor_*, neighbor_*)``.

    Tracks go to workers in contiguous shuffled ranges; the pairs of a worker are
    shuffled and cut in full batches.
    """
    # both are read several times below
    windows = cut_lineage(windows)
    neighbours = cut_lineage(window_neighbours(profile, width))
    tracks = number_shuffled(
        windows.select("track").distinct(), [], seed, ["track"], "_t", "_n_t"
    ).select("track", worker_of(F.col("_t"), F.col("_n_t"), workers).alias("worker"))
    pairs = neighbour_pairs(neighbours, windows).join(tracks, "track")
    numbered = number_shuffled(
        pairs, ["worker"], seed, ["track", "anchor_win_idx"], "row_idx", "n"
    )
    return full_batches(numbered, size).drop("row_idx", "n")


def pair_triplets(batches: DataFrame, size: int, seed, payload: list[str]) -> DataFrame:
    """Batches completed by a distant window from another pair of the batch."""
    return batch_distants(batches, ["worker", "batch"], size, seed, payload)


def requests(windows: DataFrame, nearest: DataFrame, workers: int, seed) -> DataFrame:
    """``(worker, track, <window>, nbr)``: windows with their neighbour's number, if any, and their track's worker.

    ``windows`` has ``track, win_idx`` and a payload, ``nearest`` has ``track, win_idx, nbr``.
    """
    windows = cut_lineage(windows)
    tracks = number_shuffled(windows.select("track").distinct(), [], seed, ["track"], "_t", "_n_t")
    tracks = tracks.select("track", worker_of(F.col("_t"), F.col("_n_t"), workers).alias("worker"))
    met = windows.join(nearest, ["track", "win_idx"], "left").join(tracks, "track")
    return cut_lineage(met.select("worker", *windows.columns, "nbr"))
