"""Recordings and pairs processed as they arrive.

Every micro-batch goes to its own folder and overwrites it when it is run
again, so a restarted query leaves neither gaps nor doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of parquet files, a few files per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def run_batches(
    stream: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    mode: str = "append",
) -> StreamingQuery:
    """Apply ``work`` to every micro-batch and keep its result under ``out``.

    Handles everything that has arrived and then stops.
    """

    def keep(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(keep)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def files_for(rows: int, most_rows: int = 250_000, least: int = 8) -> int:
    """In how many files a table of so many rows arrives."""
    return max(least, -(-rows // most_rows))


def files_per_batch(files: int, batches: int = 2, least: int = 4) -> int:
    """Files of one micro-batch, so that a table of any size arrives in so many of them.

    Every open key is touched by every micro-batch: with more of them for more rows the work would grow with the square.
    """
    return max(least, -(-files // batches))


def spread(df: DataFrame, time: str) -> str:
    """The time between the first and the last row, as a delay that no row exceeds."""
    seconds = df.agg((F.unix_seconds(F.max(time)) - F.unix_seconds(F.min(time))).alias("s")).first()["s"]
    return f"{int(seconds or 0) + 1} seconds"


def time_windows(
    stream: DataFrame, time: str, width: str, delay: str, keys: list[str], value: str
) -> DataFrame:
    """Counts and sums per time window.

    A window is open until ``delay`` after its end has been seen; appended, it is given once then and forgotten.
    """
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(*keys, F.col("_w.start").alias("start"), "n", "total")
    )


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest state of every key out of a table of updates by ``batch``."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), F.col("batch")).alias("_s")
    return updates.groupBy(*keys).agg(newest).select(*keys, "_s.*")
