"""Model training and scoring queries. Results depend on the learner: no SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.catalog.registry import query
from trackweave.catalog.sqltext import digest
from trackweave.operators import metrics, sampling
from trackweave.plans import learn
from trackweave.session import cut_lineage
from trackweave.sources.tracks import table

SEED = 2022


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return learn.with_features(table(spark, sf, "embeddings"), "embedding").select(
        "vec_id", F.col("label").cast("int").alias("label"), "features"
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Binary rows ``(doc_id, target, features)`` out of labelled documents."""
    text = F.col("text")
    chars = F.greatest(F.length(text), F.lit(1))
    features = F.array(
        F.log1p(F.length(text).cast("double")),
        F.length(F.regexp_replace(text, "[^0-9]", "")) / chars,
        F.length(F.regexp_replace(text, "[^\n]", "")) / chars,
        F.length(F.regexp_replace(text, "[^.,;!?]", "")) / chars,
        F.size(F.array_distinct(F.split(text, " "))) / F.size(F.split(text, " ")),
    )
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = learn.with_features(docs.withColumn("_f", features), "_f")
    return rows.select("doc_id", F.col("quality").alias("target"), "features")


def weighted(rows: DataFrame) -> DataFrame:
    return rows.join(sampling.balanced_weights(rows, "target").drop("n"), "target")


@query("l2_class_trees")
def l2(spark, sf):
    """One balanced boosted-tree model per class; precision, recall and F1 on a test part."""
    rows = cut_lineage(sampling.split_two(vectors(spark, sf), 0.9, SEED, ["vec_id"]))
    models = learn.class_trees(rows.where("split = 'train'"), SEED, rounds=3, depth=3)
    got = learn.class_predictions(rows.where("split = 'test'"), models, ["vec_id", "label"])
    return metrics.class_scores(got, "bird", F.col("label") == F.col("bird"), F.col("target"))


@query("l3_no_call_model")
def l3(spark, sf):
    """A binary model with early stopping; AUC on the test part."""
    rows = cut_lineage(sampling.split_three(weighted(calls(spark, sf)), 0.85, SEED, ["doc_id"]))
    known = rows.where("split <> 'test'").withColumn("held_out", F.col("split") == "val")
    model = learn.binary_trees(known, SEED, "held_out", rounds=10, depth=3)
    scored = model.transform(rows.where("split = 'test'")).select(
        "target", vector_to_array("probability")[1].alias("p")
    )
    return metrics.roc_auc(scored, "p", "target", F.floor(F.col("p") * 4096))


@query("l4_no_call_cross_validation")
def l4(spark, sf):
    rows = sampling.folds(weighted(calls(spark, sf)), 5, SEED, ["doc_id"])
    return learn.cross_validated(rows, "fold", 5, SEED, rounds=3, depth=3)


@query("l5_scored_ids")
def l5(spark, sf):
    """Every row scored by a model that was fitted on the other half, with its id."""
    rows = cut_lineage(sampling.folds(weighted(calls(spark, sf)), 2, SEED, ["doc_id"]))
    halves = []
    for own in (0, 1):
        model = learn.binary_trees(rows.where(F.col("fold") != own), SEED, rounds=5, depth=3)
        halves.append(model.transform(rows.where(F.col("fold") == own)))
    return halves[0].unionByName(halves[1]).select("doc_id", vector_to_array("probability")[1].alias("score"))


@query("l6_pca")
def l6(spark, sf):
    plane = learn.projected(vectors(spark, sf), 2)
    return plane.select("vec_id", F.posexplode(vector_to_array("pca")).alias("dim", "value"))


@query("l7_kmeans")
def l7(spark, sf):
    return learn.clusters(vectors(spark, sf), 3, SEED).select("vec_id", "cluster")


@query("l8_embedding_probe")
def l8(spark, sf):
    """Mean and deviation of the probe's accuracy over repeated runs."""
    runs = learn.probe(vectors(spark, sf), 40, 32, 3, SEED, "vec_id")
    return runs.agg(
        F.count("*").alias("n"), F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std")
    )


PROBE = 25
RUNS = 10


@query(
    "l8_probe_rows",
    f"""WITH drawn AS (
          SELECT run, label, vec_id FROM (
            SELECT run, label, vec_id, row_number() OVER (PARTITION BY run, label ORDER BY {digest(SEED, "run", "vec_id")}, run, vec_id) AS r
            FROM embeddings, (SELECT unnest(range({RUNS})) AS run)) WHERE r <= {PROBE}),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY run ORDER BY {digest(f"{SEED}-split", "run", "vec_id")}, run, vec_id) - 1 AS i,
                 count(*) OVER (PARTITION BY run) AS n FROM drawn)
        SELECT CAST(run AS INTEGER) AS run, vec_id, CAST(label AS INTEGER) AS label,
               CASE WHEN i < floor(0.67::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM placed""",
)
def l8_rows(spark, sf):
    """The rows of every run of the probe: so many of each class, two thirds for training."""
    return learn.probe_rows(vectors(spark, sf), PROBE, RUNS, SEED, "vec_id")


@query("l8_probe_by_dimension")
def l8_grid(spark, sf):
    """Mean and deviation of the probe's accuracy over ten runs of each dimension."""
    grid = learn.probe_grid(vectors(spark, sf), PROBE, [8, 16, 32], RUNS, SEED, "vec_id")
    return grid.groupBy("dim").agg(
        F.count("*").alias("n"), F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std")
    )


@query("l9_perceptron")
def l9(spark, sf):
    """A feed-forward classifier on vectors; test accuracy per class."""
    rows = cut_lineage(sampling.split_two(vectors(spark, sf), 0.9, SEED, ["vec_id"]))
    model = learn.perceptron(rows.where("split = 'train'"), [64, 32, 10], SEED, rounds=20)
    got = model.transform(rows.where("split = 'test'"))
    return got.groupBy("label").agg(
        F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy")
    )


@query("l17_intra_class_clusters")
def l17_intra(spark, sf):
    """Plane coordinates and cluster of sampled vectors of one class."""
    one = vectors(spark, sf).where("label = 3")
    sample = cut_lineage(sampling.sample_without_replacement(one, [], 50, SEED, ["vec_id"]))
    return learn.cluster_table(sample, ["vec_id"], 3, SEED)


@query("l17_inter_class_plane")
def l17_inter(spark, sf):
    """Plane coordinates of sampled vectors of several classes."""
    some = vectors(spark, sf).where(F.col("label").isin(1, 4, 7))
    sample = cut_lineage(sampling.sample_without_replacement(some, ["label"], 30, SEED, ["vec_id"]))
    xy = vector_to_array("pca")
    return learn.projected(sample, 2).select("vec_id", "label", xy[0].alias("x"), xy[1].alias("y"))
