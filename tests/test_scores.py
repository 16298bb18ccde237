"""Scalars, rankings, quantiles, metrics, prediction and streaming."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import scalar, vectors
from trackweave.operators import labels, metrics
from trackweave.operators.quantiles import exact_quantiles
from trackweave.plans import predict
from trackweave.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hop_length(spark):
    assert one(spark, scalar.hop_length(32000, 10))[0] == 3200
    assert one(spark, scalar.hop_length(22050, 10))[0] == 2176


@pytest.mark.parametrize("index,window,frames,data,extra", [(0, 50, 292, 921600, 0), (77, 50, 292, 28, 10)])
def test_frame_to_data(spark, index, window, frames, data, extra):
    start, end = scalar.frame_to_data(F.lit(index), F.lit(window), F.lit(frames), F.lit(data), extra)
    whole, half = frames + window, window / 2
    assert tuple(one(spark, start, end)) == (
        int((index / whole + half / whole) * data),
        int(((index + window + extra) / whole + half / whole) * data),
    )


def test_duration_rounds_like_python(spark):
    rows = spark.range(20000).select("id", scalar.duration_seconds(F.col("id"), F.lit(320.0)).alias("s"))
    assert all(r.s == round(r.id / 320.0, 2) for r in rows.collect())


@pytest.mark.parametrize(
    "text,seconds",
    [("3:20", 200), ("1:02:03", 124), ("03:", 180), ("", -1), (None, -1), ("5", -1), ("?", -1), ("1:2:3:4", -1)],
)
def test_clock(spark, text, seconds):
    df = spark.createDataFrame([(text,)], "t string")
    scalar.register(spark)
    assert df.select(scalar.seconds_of_clock(F.col("t"))).first()[0] == seconds
    assert df.selectExpr("seconds_of_clock(t)").first()[0] == seconds


def test_clock_with_hours(spark):
    df = spark.createDataFrame([("1:02:03",)], "t string")
    assert df.select(scalar.seconds_of_clock(F.col("t"), fix_hours=True)).first()[0] == 3723


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c/name.x.ogg",)], "p string")
    p = F.col("p")
    got = df.select(
        scalar.path_part(p, 1), scalar.path_part(p, 9), scalar.file_stem(p), scalar.last_parts(p, 3), scalar.last_parts(p, 8)
    ).first()
    assert tuple(got) == ("b", None, "name", "b/c/name.x.ogg", "a/b/c/name.x.ogg")


def test_rotate_and_crop(spark):
    x = F.array(*[F.lit(float(i)) for i in range(5)])
    got = one(spark, vectors.rotate(x, F.lit(2)), vectors.rotate(x, F.lit(-1)), vectors.crop(x, F.lit(1), 3))
    assert [list(v) for v in got] == [[3, 4, 0, 1, 2], [1, 2, 3, 4, 0], [1, 2, 3]]


def test_noise_scale(spark):
    x = F.array(*[F.lit(v) for v in (3.0, 4.0)])
    assert math.isclose(one(spark, vectors.noise_scale(x, F.lit(10.0)))[0], math.sqrt(12.5 / 10))


def test_rankings(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9, 0.9, 0.3])], "id int, s array<double>")
    assert [(r["rank"], r.idx) for r in labels.class_ranks(df, "s", ["id"]).collect()] == [(1, 2), (2, 1), (3, 3), (4, 0)]
    assert [r.idx for r in labels.top_classes(df, "s", ["id"], 1).collect()] == [2]
    assert [r.idx for r in labels.classes_above(df, "s", ["id"], F.lit(3)).collect()] == [2, 1]
    assert labels.classes_above(df, "s", ["id"], F.lit(2)).count() == 0


def test_class_table(spark):
    df = spark.createDataFrame([("foo",), ("bar",), ("baz",), ("bar",), (None,)], "label string")
    got = {r.label: r.idx for r in labels.class_table(df, extra=["noise"]).collect()}
    assert got == {"bar": 0, "baz": 1, "foo": 2, "noise": 3}


def test_collapse_needs_a_list(spark):
    df = spark.createDataFrame([("a",), ("b",)], "label string")
    names = df.where("label = 'a'")
    assert sorted(r.label for r in labels.others_collapsed(df, "label", names).collect()) == ["a", "other"]
    assert sorted(r.label for r in labels.others_collapsed(df, "label", names.limit(0)).collect()) == ["a", "b"]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(spark, accuracy):
    random.seed(1)
    rows = [("big", random.lognormvariate(0, 2)) for _ in range(5000)]
    rows += [("flat", float(random.randint(0, 3))) for _ in range(3000)]
    rows += [("few", v) for v in (1.0, 2.0, 4.0)] + [(None, 5.0), ("big", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q0": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q999": 0.999, "q1": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, accuracy).collect()}
    for g in ("big", "flat", "few", None):
        values = [v for k, v in rows if k == g and v is not None]
        for name, p in probs.items():
            assert math.isclose(got[g][name], float(np.quantile(values, p)), rel_tol=1e-12), (g, name)
    everything = exact_quantiles(df, [], "v", {"m": 0.5}, accuracy).first()
    assert math.isclose(everything.m, float(np.median([v for _, v in rows if v is not None])))


def test_class_scores(spark):
    rows = [(1, True, True)] * 3 + [(1, False, True)] + [(1, True, False)] * 2 + [(2, True, False), (2, False, True)]
    df = spark.createDataFrame(rows, "bird int, label boolean, target boolean")
    got = {r.bird: r for r in metrics.class_scores(df, "bird", F.col("label"), F.col("target")).collect()}
    assert (got[1].precision, got[1].recall) == (0.75, 0.6)
    assert math.isclose(got[1].f1, 2 * 0.75 * 0.6 / 1.35)
    assert (got[2].precision, got[2].recall, got[2].f1) == (0.0, 0.0, 0.0)


def test_roc_auc(spark):
    random.seed(2)
    rows = [(random.randint(0, 30) / 30, random.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    for cells in (1, 8, 4096):
        got = metrics.roc_auc(df, "s", "y", F.floor(F.col("s") * cells)).first().auc
        assert math.isclose(got, want)


def test_triplet_loss(spark):
    rng = np.random.default_rng(5)
    a, n, d = rng.normal(size=(3, 20, 6))
    df = spark.createDataFrame([(x.tolist(), y.tolist(), z.tolist()) for x, y, z in zip(a, n, d)], "a array<double>, n array<double>, d array<double>")
    got = metrics.triplet_loss(df, F.col("a"), F.col("n"), F.col("d"), margin=1.0).first()
    near, far = np.linalg.norm(a - n, axis=1), np.linalg.norm(a - d, axis=1)
    penalty = sum(np.linalg.norm(x, axis=1) for x in (a, n, d))
    assert math.isclose(got.loss, np.mean(np.maximum(near - far + 1, 0) + 0.01 * penalty))
    assert math.isclose(got.gap, np.mean(near - far))


def test_cross_entropy_is_bounded(spark):
    got = one(spark, metrics.cross_entropy(F.lit(0.0), F.lit(1.0)), metrics.cross_entropy(F.lit(0.5), F.lit(1.0)))
    assert got[0] == 100.0 and math.isclose(got[1], math.log(2))


def test_histogram_counts_the_top_edge(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9.99, 10)], "v double")
    got = {r.bin: r.n for r in metrics.histogram(df, F.col("v"), F.lit(0.0), F.lit(10.0), 2).collect()}
    assert got == {0: 2, 1: 3}


@pytest.mark.parametrize("max_classes", [10, 1])
def test_centroid_scores(spark, max_classes):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, label int, v array<double>")
    centres = predict.centroids(df, "label", "v")
    means = np.array([np.mean([v for _, k, v in rows if k == c], axis=0) for c in range(3)])
    # a class list beyond the bound is joined instead of sent along
    got = predict.centroid_scores(df, ["id"], "v", centres, max_classes)
    for r in got.collect():
        assert np.allclose(r.scores, means @ np.array(rows[r.id][2]), atol=1e-8)


def test_submission(spark):
    windows = spark.createDataFrame([("f", 0), ("f", 5), ("f", 10)], "file_id string, end_time int")
    classes = spark.createDataFrame([("a", 0), ("noise", 1)], "label string, idx int")
    scored = spark.createDataFrame([("f", 5, [0.9, 0.1]), ("f", 10, [0.2, 0.7])], "file_id string, end_time int, scores array<double>")
    for method in ("top", "top-not-noise"):
        named = predict.predicted_rows(scored, classes, method)
        grid = predict.evaluation_grid(windows, classes)
        got = {r.row_id: r.target for r in predict.submission(grid, named, "noise").collect()}
        assert got == {"f_a_5": True, "f_a_10": False, "f_noise_5": False, "f_noise_10": False}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(
        (F.col("id") % 3).alias("track"),
        F.timestamp_seconds(F.col("id") * 2).alias("ts"),
        F.col("id").cast("double").alias("value"),
    )
    rows.repartition(10).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_arriving(spark, str(tmp_path / "in"), "track bigint, ts timestamp, value double")
    windows = ingest.time_windows(stream, "ts", "5 seconds", "1 day", ["track"], "value")
    query = ingest.run_batches(windows, lambda b: b, str(tmp_path / "out"), str(tmp_path / "state"), "update")
    query.awaitTermination()
    updates = spark.read.parquet(str(tmp_path / "out"))
    assert updates.select("batch").distinct().count() == 3
    got = ingest.latest(updates, ["track", "start"]).collect()
    want = rows.groupBy("track", F.window("ts", "5 seconds").start.alias("start")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
