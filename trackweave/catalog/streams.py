"""Structured Streaming queries over the event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.catalog.registry import query
from trackweave.catalog.samples import PAIR_WINDOWS_SQL, pair_requests
from trackweave.catalog.signals import CHUNK, slices_sql
from trackweave.catalog.sqltext import FRAMES, digest as digest_sql
from trackweave.functions import vectors
from trackweave.functions.draws import digest
from trackweave.operators.numbering import number_rows
from trackweave.operators.windows import slice_windows
from trackweave.session import work_path
from trackweave.sources.tracks import chunked, frames, lengths, minute_of, table
from trackweave.streaming import ingest, state

# a last row far in the future tells a stream that all recordings have ended
END = "2100-01-01"
WINDOWS_PER_SLICE = 2
PAIRS_PER_BATCH = 16
LIMIT = 5


@query(
    "r1_arriving_recordings",
    f"""WITH {FRAMES}, {slices_sql(10, 0, None, "center")}
        SELECT track, win_idx, win_idx * 5 AS end_time, round(avg(value), 6) AS score FROM slices GROUP BY 1, 2""",
)
def r1(spark, sf):
    """Whole recordings arrive four files at a time, are sliced and scored."""
    root = work_path(spark, "arriving")
    recordings = frames(spark, sf).select("track", "pos", "value")
    files = ingest.files_for(table(spark, sf, "events").count())
    recordings.repartition(files, "track").write.parquet(f"{root}/in")

    def score(batch):
        windows = slice_windows(chunked(batch, CHUNK), lengths(batch), CHUNK, 10)
        mean = vectors.total(F.col("x")) / F.size("x")
        return windows.select(
            "track", "win_idx", (F.col("win_idx") * 5).alias("end_time"), F.round(mean, 6).alias("score")
        )

    stream = ingest.read_arriving(spark, f"{root}/in", "track bigint, pos bigint, value double")
    ingest.run_batches(stream, score, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def timed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """``(track, ts, pos, value)`` and a last row of no track."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("track"), "ts", "event_id", "value")
    numbered = number_rows(events, ["track"], ["ts", "event_id"], minute_of("ts"), "pos")
    rows = numbered.select("track", F.col("ts").cast("timestamp").alias("ts"), "pos", "value")
    last = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("track"), F.lit(END).cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("pos"), F.lit(0.0).alias("value")
    )
    return rows.unionByName(last)


@query(
    "r1_spread_recordings",
    f"""WITH {FRAMES}, {slices_sql(10, 0, 4, "right-align")}
        SELECT track, win_idx, start_pos, round(avg(value), 6) AS score FROM slices GROUP BY 1, 2, 3""",
)
def r1_spread(spark, sf):
    """Recordings spread over files in the order of time, cut in overlapping windows across the files' borders."""
    root = work_path(spark, "spread")
    files = ingest.files_for(table(spark, sf, "events").count())
    state.write_in_order(timed_frames(spark, sf), f"{root}/in", "ts", files)
    kinds = "track bigint, ts timestamp, pos bigint, value double"
    stream = ingest.read_arriving(spark, f"{root}/in", kinds, ingest.files_per_batch(files))
    # a recording has ended when nothing of it came for a year
    cutter = state.WindowCutter(10, 4, "right-align", gap_ms=365 * 24 * 3600 * 1000)
    with state.keyed_state(spark):
        windows = state.arriving_windows(stream, "1 minute", cutter)
        ingest.run_batches(windows, lambda b: b, f"{root}/out", f"{root}/state").awaitTermination()
    mean = vectors.total(F.col("x")) / F.size("x")
    return spark.read.parquet(f"{root}/out").where("track >= 0").select("track", "win_idx", "start_pos", F.round(mean, 6).alias("score"))


@query(
    "r2_time_windows",
    """SELECT user_id AS track, CAST(floor(epoch(ts) / 5) * 5 AS BIGINT) AS start, count(*) AS n, round(sum(value), 6) AS total
       FROM events GROUP BY 1, 2""",
)
def r2(spark, sf):
    """Five-second windows per recording over event files that arrive in the order of time."""
    root = work_path(spark, "windows")
    files = ingest.files_for(table(spark, sf, "events").count())
    events = timed_frames(spark, sf).select("track", "ts", "value")
    state.write_in_order(events, f"{root}/in", "ts", files)
    stream = ingest.read_arriving(spark, f"{root}/in", "track bigint, ts timestamp, value double")
    windows = ingest.time_windows(stream, "ts", "5 seconds", "1 minute", ["track"], "value")
    ingest.run_batches(windows, lambda b: b, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").where("track >= 0").select(
        "track",
        # the session's time zone cancels out
        F.expr("timestampdiff(SECOND, TIMESTAMP'1970-01-01', start)").alias("start"),
        "n",
        F.round("total", 6).alias("total"),
    )


def _batches_sql(limit: int) -> str:
    end = f"WHERE worker = 0 AND batch < {limit}" if limit > 0 else ""
    return f"""{PAIR_WINDOWS_SQL},
        later AS (SELECT *, greatest(anchor_win_idx, neighbor_win_idx) // {WINDOWS_PER_SLICE} AS slice FROM pairs),
        numbered AS (
          SELECT *, count(*) OVER (PARTITION BY worker) AS n, row_number() OVER (
            PARTITION BY worker ORDER BY slice, {digest_sql(83, "track", "anchor_win_idx")}, track, anchor_win_idx) - 1 AS idx
          FROM later),
        streamed AS (
          SELECT worker, idx // {PAIRS_PER_BATCH} AS batch, CAST(idx % {PAIRS_PER_BATCH} AS INTEGER) AS slot, track,
                 anchor_win_idx, anchor_total, neighbor_win_idx, neighbor_total
          FROM numbered WHERE idx // {PAIRS_PER_BATCH} < n // {PAIRS_PER_BATCH})
        SELECT * FROM streamed {end}"""


def streamed_batches(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    """Batches of pairs formed while windows arrive, some windows of every track at a time."""
    root = work_path(spark, "pairs")
    windows = pair_requests(spark, sf).withColumn("slice", F.expr(f"win_idx div {WINDOWS_PER_SLICE}"))
    ends = windows.groupBy("worker", "track").agg(F.max("slice").alias("slice"))
    none = F.lit(None)
    ends = ends.select("*", none.cast("bigint").alias("win_idx"), none.cast("double").alias("total"), none.cast("bigint").alias("nbr"))
    rows = windows.unionByName(ends)
    slices = rows.agg(F.max("slice").alias("s")).first()["s"] or 0
    state.write_in_order(rows, f"{root}/in", "slice", slices + 1)
    stream = ingest.read_arriving(spark, f"{root}/in", rows.schema.simpleString()[7:-1].replace(":", " "))
    with state.keyed_state(spark):
        pairs = state.arriving_pairs(stream)
        made = state.arriving_batches(pairs, state.BatchMaker(PAIRS_PER_BATCH, limit), digest(83, "track", "anchor_win_idx"))
        ingest.run_batches(made.withColumnRenamed("batch", "pair_batch"), lambda b: b, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch").withColumnRenamed("pair_batch", "batch")


@query("r3_limited_pair_stream", _batches_sql(LIMIT))
def r3(spark, sf):
    """The pair stream with a limit of five batches, all taken from worker 0."""
    return streamed_batches(spark, sf, LIMIT)


@query("r3_pair_stream", _batches_sql(-1))
def r3_whole(spark, sf):
    """All full batches of every worker."""
    return streamed_batches(spark, sf, -1)
