"""Missing frames, missing neighbours, missing tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions.project import linear_map
from trackweave.operators.pairing import window_neighbours
from trackweave.operators.profile import matrix_profile
from trackweave.session import work_path
from trackweave.sources import files
from trackweave.streaming import ingest


def profile_by_force(x, m):
    n = len(x) - m + 1
    out = {}
    for i in range(n):
        best, at = math.inf, -1
        for j in range(n):
            if abs(i - j) > m // 2:
                d = math.sqrt(sum((x[i + k] - x[j + k]) ** 2 for k in range(m)))
                if d < best:  # false for NaN
                    best, at = d, j
        out[i] = at
    return out


@pytest.mark.parametrize("gap", [None, float("nan"), float("inf")])
def test_a_gap_takes_out_only_its_windows(spark, gap):
    x = np.random.default_rng(4).standard_normal(40).tolist()
    x[20] = gap
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "track bigint, pos bigint, value double")
    got = {r["i"]: r["pi"] for r in matrix_profile(frames, 4).collect()}
    want = profile_by_force([float("nan") if v is None else v for v in x], 4)
    assert got == want and sum(v >= 0 for v in got.values()) == 33


def test_a_null_vector_frame(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, None if i == 7 else rng.standard_normal(3).tolist()) for i in range(24)]
    frames = spark.createDataFrame(rows, "track bigint, pos bigint, frame array<double>")
    got = {r["i"]: r["pi"] for r in matrix_profile(frames, 4, "frame").collect()}
    assert [i for i, p in got.items() if p < 0] == [4, 5, 6, 7] or {i for i, p in got.items() if p < 0} == {4, 5, 6, 7}


def test_a_window_longer_than_the_default_block(spark):
    frames = spark.range(9000).selectExpr("1L AS track", "id AS pos", "sin(id * id) AS value")
    got = matrix_profile(frames, 4200).agg(F.count("*").alias("n"), F.max("pi").alias("last")).first()
    assert got["n"] == 4801 and got["last"] > 0


def test_no_neighbour_does_not_vote(spark):
    x = np.random.default_rng(6).standard_normal(10).tolist()
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "track bigint, pos bigint, value double")
    found = matrix_profile(frames, 8)
    assert {r["pi"] for r in found.collect()} == {-1}
    assert window_neighbours(found, 10).count() == 0


def test_null_vectors_are_mapped_to_null(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 1.0])], "k bigint, v array<double>")
    got = {r["k"]: r["z"] for r in linear_map(df, ["k"], "v", np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 1.0]])).collect()}
    assert got == {1: [1.0, 2.0, 4.0], 2: None, 3: [0.0, 1.0, 1.0]}


def test_first_run_of_the_incremental_sink(spark):
    path = work_path(spark, "first")
    rows = spark.range(5).withColumnRenamed("id", "k")
    files.append_missing(rows, path, ["k"])
    files.append_missing(spark.range(8).withColumnRenamed("id", "k"), path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == list(range(8))


def test_labels_come_back_from_the_own_sink(spark):
    path = work_path(spark, "labels")
    df = spark.createDataFrame([(1, "a b"), (2, "x=y"), (3, "plain")], "k bigint, label string")
    files.write_by_label(df, path)
    assert {r["label"] for r in files.list_files(spark, path, "*.parquet").collect()} == {"a b", "x=y", "plain"}


def test_time_windows_over_a_long_collection(spark):
    """Files out of order over 400 days: nothing is late enough to be dropped."""
    root = work_path(spark, "long")
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, start + dt.timedelta(days=(k * 37) % 400, seconds=k), 1.0) for k in range(240)]
    df = spark.createDataFrame(rows, "track bigint, ts timestamp, value double")
    df.repartition(12).write.parquet(f"{root}/in")
    stream = ingest.read_arriving(spark, f"{root}/in", "track bigint, ts timestamp, value double", 2)
    delay = ingest.spread(spark.read.parquet(f"{root}/in"), "ts")
    windows = ingest.time_windows(stream, "ts", "5 seconds", delay, ["track"], "value")
    ingest.run_batches(windows, lambda b: b, f"{root}/out", f"{root}/state", "update").awaitTermination()
    got = ingest.latest(spark.read.parquet(f"{root}/out"), ["track", "start"])
    assert got.agg(F.sum("n")).first()[0] == 240
