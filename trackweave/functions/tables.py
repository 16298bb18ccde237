"""Table functions over ordered groups: one pass, a few numbers of state, many or no rows out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udtf

RUNS = "track bigint, start_pos bigint, end_pos bigint, n bigint, peak double"


class LoudRuns:
    """Runs of a track that begin at a value of at least ``high`` and last until one below ``low``.

    Input are the rows ``(track, pos, value)`` of one track in order, an Arrow batch at a time. Between the batches only
    the open run is kept, so a track may be of any length. Whether a frame between the two levels is in a run
    depends on what came before it, which no function of a single row tells. Null and NaN values change nothing.
    """

    high, low = 80.0, 40.0

    def __init__(self) -> None:
        self.open: list | None = None  # track, start, last, rows, peak

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if not batch.num_rows:
            return
        track, pos = batch.column(0)[0].as_py(), batch.column(1).to_numpy(zero_copy_only=False)
        value = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        # 1 and 0 where a value decides; what does not decide follows the last one that did
        told = np.where(value >= self.high, 1, np.where(value < self.low, 0, -1))
        last = np.maximum.accumulate(np.where(told >= 0, np.arange(len(told)), -1))
        inside = np.where(last >= 0, told[np.maximum(last, 0)], int(self.open is not None)) == 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        done = []
        if self.open is not None and not inside[0]:
            done.append(self.open)
            self.open = None
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            some = value[a:b]
            some = some[~np.isnan(some)]
            peak = float(some.max()) if len(some) else -np.inf
            if a == 0 and self.open is not None:
                run = [track, self.open[1], int(pos[b - 1]), self.open[3] + b - a, max(self.open[4], peak)]
            else:
                run = [track, int(pos[a]), int(pos[b - 1]), b - a, peak]
            self.open = run if b == len(inside) else None
            if self.open is None:
                done.append(run)
        if done:
            yield self._table(done)

    def terminate(self) -> Iterator[pa.Table]:
        if self.open is not None:
            yield self._table([self.open])

    @staticmethod
    def _table(rows: list) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = [c.split()[0] for c in RUNS.split(", ")]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def loud_runs(high: float, low: float):
    """A table function to be called with a table partitioned by track and ordered by position."""
    if low > high:
        raise ValueError("the lower level is above the higher one")
    return arrow_udtf(type("LoudRunsBetween", (LoudRuns,), {"high": high, "low": low}), returnType=RUNS)
