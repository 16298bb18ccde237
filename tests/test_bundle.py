"""Saved models: what is loaded predicts what was fitted."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.sql import functions as F

from trackweave.plans import bundle


@pytest.fixture(scope="module")
def samples(spark):
    """Twelve tracks: the loud ones swing, the quiet ones do not."""
    rows = [(t, p, (p % 2) * (10.0 if t % 2 else 0.5) + t * 1e-3) for t in range(12) for p in range(23 + t)]
    return spark.createDataFrame(rows, "track bigint, pos bigint, value double").cache()


@pytest.fixture(scope="module")
def truth(spark):
    rows = [(t, "loud" if t % 2 else "quiet") for t in range(10)] + [(10, None)]
    return spark.createDataFrame(rows, "track bigint, label string")


def stages(label="start"):
    return [bundle.SliceWindows(width=5, chunk=8, label=label), bundle.WindowFeatures()]


def named(model, samples, **kw):
    return {(r["file_id"], r["end_time"]): r["bird"] for r in bundle.predictions(model, samples, **kw).collect()}


def test_window_labels(samples):
    for label, first in (("start", 0), ("end", 5)):
        rows = bundle.SliceWindows(width=5, chunk=8, label=label).transform(samples).where("file_id = 0").collect()
        assert sorted(r["end_time"] for r in rows) == [first + 5 * i for i in range(5)]
    with pytest.raises(ValueError):
        bundle.SliceWindows(width=5, label="middle")


def test_features(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>")
    values = bundle.WindowFeatures().transform(df).first()["features"].toArray().tolist()
    assert values == [2.333333, 1.247219, 1.0, 4.0]


@pytest.mark.parametrize("kind", ["means", "logistic"])
def test_loaded_is_fitted(spark, samples, truth, tmp_path, kind):
    if kind == "means":
        fitted = bundle.fit_bundle(samples, truth, stages(), bundle.CentroidClassifier())
    else:
        fitted = bundle.fit_probabilities(samples, truth, stages(), LogisticRegression(regParam=0.01))
    path = str(tmp_path / kind)
    bundle.save_bundle(spark, fitted, path, width=5, kind=kind)
    loaded, record = bundle.load_bundle(spark, path)
    assert isinstance(loaded, PipelineModel) and record["kind"] == kind and record["created"]
    got = named(loaded, samples)
    assert got == named(fitted, samples)
    assert all(bird == ("loud" if track % 2 else "quiet") for (track, _), bird in got.items())
    assert {track for track, _ in got} == set(range(12))  # tracks without label are scored too


def test_grid_and_sentinel(spark, samples, truth, tmp_path):
    fitted = bundle.fit_bundle(samples, truth, stages("end"), bundle.CentroidClassifier())
    grid = stages("end")[0].transform(samples).select("file_id", "end_time")
    grid = grid.crossJoin(spark.createDataFrame([("loud",), ("quiet",), ("other",)], "bird string"))
    grid = grid.withColumn("row_id", F.concat_ws("_", "file_id", "bird", "end_time"))
    rows = {r["row_id"]: r["target"] for r in bundle.predict_grid(fitted, samples, grid, "quiet").collect()}
    assert len(rows) == grid.count()
    assert all(hit == (int(i.split("_")[0]) % 2 == 1 and "loud" in i) for i, hit in rows.items())


def test_other_learners_fit_in(spark, samples, truth):
    """Any estimator of pyspark.ml takes the features."""
    windows = samples
    for stage in stages():
        windows = stage.transform(windows)
    rows = windows.join(truth.withColumnRenamed("track", "file_id"), "file_id").withColumn("label", (F.col("label") == "loud").cast("double"))
    model = OneVsRest(classifier=LogisticRegression(regParam=0.01)).fit(rows.where("label IS NOT NULL"))
    assert model.transform(rows).where("label IS NOT NULL AND label <> prediction").count() == 0
