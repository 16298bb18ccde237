"""Groups of consecutive rows in a stream of Arrow batches.

For rows that Spark has dealt out and sorted by a key: each task walks over its groups
without one call per group of Spark's own, and holds one group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before it."""
    out = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for k in keys:
        x = batch.column(k).to_numpy(zero_copy_only=False)
        out |= x[1:] != x[:-1]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of equal ``keys``, each as one table. Keys are numbers without nulls."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero(_changes(batch, keys)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            held.append(batch.slice(a, b - a))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The same rows in tables of whole groups, about a batch each; a longer group is a table of its own."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        turns = np.flatnonzero(_changes(batch, keys))
        if len(turns):
            last = int(turns[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
