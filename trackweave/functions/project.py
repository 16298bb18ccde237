"""Batched linear maps of vectors inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def linear_map(
    df: DataFrame, keys: Sequence[str], vector: str, weights: np.ndarray, batch_size: int = 50
) -> DataFrame:
    """``(keys, z)``: vectors times a fixed ``weights`` matrix, in small batches.

    The weights are a model's and travel with the task; rows never leave it. A null
    vector gives a null result.
    """
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, batch_size):
                batch = big.slice(lo, batch_size)
                column = batch.column(vector)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                z = flat.reshape(int(there.sum()), weights.shape[0]).astype(np.float64) @ weights
                ends = np.concatenate([[0], np.cumsum(there * weights.shape[1])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()), mask=pa.array(~there))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k) for k in keys], lists], names=[*keys, "z"]
                )

    return df.select(*keys, vector).mapInArrow(run, f"{fields}, z array<double>")
