"""Models on small tables whose classes are plain."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trackweave.plans import learn


@pytest.fixture(scope="module")
def vectors(spark):
    """Three classes, far apart in two of six dimensions."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, (rng.normal(size=6) * 0.1 + [5.0 * (i % 3), -3.0 * (i % 3 == 1), 0, 0, 0, 0]).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, x array<double>")
    return learn.with_features(df, "x").select("vec_id", "label", "features").cache()


def test_components_are_those_of_the_centred_vectors(vectors):
    x = np.array([r["features"].toArray() for r in vectors.orderBy("vec_id").collect()])
    got = np.array([r["p"] for r in learn.projected(vectors, 3).orderBy("vec_id").select(vector_to_array("pca").alias("p")).collect()])
    centred = x - x.mean(axis=0)
    values = np.linalg.svd(centred, compute_uv=False)[:3]
    assert np.allclose(np.sqrt((got**2).sum(axis=0)), values)
    assert np.allclose(got.mean(axis=0), 0)


def test_clusters_are_the_classes(vectors):
    found = learn.clusters(vectors, 3, 1).select("label", "cluster").distinct().collect()
    assert len(found) == 3 and len({r["cluster"] for r in found}) == 3


def test_probe_rows_and_grid(vectors):
    rows = learn.probe_rows(vectors, 20, 4, 9, "vec_id")
    counts = rows.groupBy("run", "label").count().collect()
    assert len(counts) == 12 and all(r["count"] == 20 for r in counts)
    assert rows.where("split = 'train'").groupBy("run").count().select("count").distinct().first()[0] == int(0.67 * 60)
    assert rows.groupBy("run", "vec_id").count().where("count > 1").isEmpty()
    assert rows.select("vec_id").distinct().count() > 100  # the runs draw different rows
    grid = learn.probe_grid(vectors, 20, [1, 3], 2, 9, "vec_id", at_once=2).collect()
    assert {(r["dim"], r["run"]) for r in grid} == {(d, k) for d in (1, 3) for k in (0, 1)}
    assert all(r["n_train"] == 40 and r["n_test"] == 20 for r in grid)
    assert all(r["accuracy"] == 1.0 for r in grid if r["dim"] == 3)


def test_binary_trees_and_perceptron(vectors):
    rows = vectors.withColumn("target", (F.col("label") == 1).cast("int")).withColumn("weight", F.lit(1.0))
    model = learn.binary_trees(rows, 3, rounds=3, depth=2)
    assert model.transform(rows).where("prediction <> target").isEmpty()
    net = learn.perceptron(vectors, [6, 4, 3], 5, rounds=60)
    assert net.transform(vectors).where("prediction <> label").count() <= 6


def test_one_model_for_each_class(vectors):
    models = learn.class_trees(vectors, 2, rounds=2, depth=2)
    got = learn.class_predictions(vectors, models, ["vec_id", "label"])
    assert got.count() == 360 and got.where("target <> (label = bird)").count() <= 4
