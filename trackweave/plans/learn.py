"""Models trained and applied with pyspark.ml on tables of vectors."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from trackweave.operators.sampling import balanced_weights, sample_without_replacement, split_two
from trackweave.session import cut_lineage


def with_features(df: DataFrame, vector: str, name: str = "features") -> DataFrame:
    """Add the array column as an ML vector."""
    return df.withColumn(name, array_to_vector(F.col(vector).cast("array<double>")))


def pca_model(df: DataFrame, k: int, features: str = "features", out: str = "pca") -> PipelineModel:
    """Centre the vectors, then project on the first ``k`` components."""
    centre = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred")
    return Pipeline(stages=[centre, PCA(k=k, inputCol="_centred", outputCol=out)]).fit(df)


def projected(df: DataFrame, k: int, features: str = "features", out: str = "pca") -> DataFrame:
    return pca_model(df, k, features, out).transform(df).drop("_centred")


def clusters(df: DataFrame, k: int, seed: int, features: str = "features") -> DataFrame:
    """Add ``cluster``: k-means on the vectors."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
    return model.transform(df)


def binary_trees(
    df: DataFrame, seed: int, validation: str | None = None, rounds: int = 20, depth: int = 5
) -> GBTClassificationModel:
    """Boosted trees on ``features, target, weight``.

    With a ``validation`` column the rounds stop when its rows get no better.
    """
    gbt = GBTClassifier(
        featuresCol="features",
        labelCol="target",
        weightCol="weight",
        maxIter=rounds,
        maxDepth=depth,
        seed=seed,
    )
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(df)


def class_trees(
    df: DataFrame, seed: int, label: str = "label", rounds: int = 20, depth: int = 5
) -> dict:
    """One balanced binary model per class, trained on a table written once."""
    rows = cut_lineage(df.select(label, "features"))
    names = [r[label] for r in rows.select(label).distinct().collect()]
    models = {}
    for name in sorted(names):
        marked = rows.withColumn("target", (F.col(label) == F.lit(name)).cast("int"))
        weighted = marked.join(balanced_weights(marked, "target").drop("n"), "target")
        models[name] = binary_trees(weighted, seed, rounds=rounds, depth=depth)
    return models


def class_predictions(df: DataFrame, models: dict, keys: Sequence[str]) -> DataFrame:
    """``(keys, bird, p, target)``: every class model applied to every row in one pass."""
    scored = df
    for i, model in enumerate(models.values()):
        named = (
            model.setPredictionCol(f"_y{i}").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}")
        )
        scored = named.transform(scored).drop(f"_r{i}")
    per_class = F.array(
        *[
            F.struct(
                F.lit(name).alias("bird"),
                vector_to_array(F.col(f"_p{i}"))[1].alias("p"),
                (F.col(f"_y{i}") == 1).alias("target"),
            )
            for i, name in enumerate(models)
        ]
    )
    return scored.select(*keys, F.explode(per_class).alias("_c")).select(*keys, "_c.*")


def cross_validated(df: DataFrame, folds: str, k: int, seed: int, rounds: int = 10, depth: int = 3) -> DataFrame:
    """``(mean_auc, std_auc)`` of boosted trees over given folds."""
    gbt = GBTClassifier(
        featuresCol="features", labelCol="target", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed
    )
    cv = CrossValidator(
        estimator=gbt,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=BinaryClassificationEvaluator(labelCol="target", metricName="areaUnderROC"),
        numFolds=k,
        foldCol=folds,
        parallelism=2,
    )
    fitted = cv.fit(cut_lineage(df))
    return df.sparkSession.range(1).select(
        F.lit(float(fitted.avgMetrics[0])).alias("mean_auc"),
        F.lit(float(fitted.stdMetrics[0])).alias("std_auc"),
    )


def probe(
    df: DataFrame, per_class: int, components: int, runs: int, seed: int, key: str, label: str = "label"
) -> DataFrame:
    """``(run, accuracy)``: how well a linear model tells classes apart.

    Each run samples rows per class, projects them, trains on two thirds and
    measures the rest.
    """
    spark = df.sparkSession
    scores = []
    for run in range(runs):
        sample = cut_lineage(sample_without_replacement(df, [label], per_class, f"{seed}-{run}", [key]))
        flat = projected(sample, components) if components else sample.withColumn("pca", F.col("features"))
        parts = split_two(flat, 0.67, f"{seed}-{run}-split", [key])
        model = LogisticRegression(featuresCol="pca", labelCol=label, maxIter=100).fit(
            parts.where("split = 'train'")
        )
        hit = model.transform(parts.where("split = 'test'")).agg(
            F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy")
        )
        scores.append(hit.withColumn("run", F.lit(run)).first())
    return spark.createDataFrame(
        [(r.run, float(r.accuracy)) for r in scores], "run int, accuracy double"
    )


def probe_rows(df: DataFrame, per_class: int, runs: int, seed, key: str, label: str = "label", train: float = 0.67) -> DataFrame:
    """``(run, <key>, <label>, split)``: for every run so many rows of each class, split for training and test.

    All runs are drawn in one job, by the digests of run and key.
    """
    each = df.select(label, key).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    drawn = sample_without_replacement(each, ["run", label], per_class, seed, ["run", key])
    return split_two(drawn, train, f"{seed}-split", ["run", key], ["run"]).select("run", key, label, "split")


def probe_grid(
    df: DataFrame, per_class: int, dims: Sequence[int], runs: int, seed, key: str, label: str = "label", at_once: int = 4
) -> DataFrame:
    """``(dim, run, n_train, n_test, accuracy)``: how well a linear model tells classes apart, by dimension and run.

    The components are fitted once, at the largest dimension; those of a smaller one are its first ones. The samples
    of all runs are one written table, over which the models of the grid are fitted, ``at_once`` at a time.
    """
    spark = df.sparkSession
    rows = probe_rows(df, per_class, runs, seed, key, label)
    flat = projected(df.select(key, "features"), max(dims)).drop("features")
    sample = cut_lineage(rows.join(flat, key).repartition("run"))

    def fitted(task: tuple[int, int]) -> tuple:
        dim, run = task
        own = VectorSlicer(inputCol="pca", outputCol="first", indices=list(range(dim))).transform(sample.where(F.col("run") == run))
        known, rest = own.where("split = 'train'"), own.where("split = 'test'")
        model = LogisticRegression(featuresCol="first", labelCol=label, maxIter=100).fit(known)
        hit = (F.col("prediction") == F.col(label)).cast("int")
        seen = model.transform(rest).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")).first()
        return dim, run, known.count(), seen["n"], float(seen["accuracy"])

    tasks = [(dim, run) for dim in dims for run in range(runs)]
    with ThreadPool(at_once) as pool:
        found = pool.map(inheritable_thread_target(spark)(fitted), tasks)
    return spark.createDataFrame(found, "dim int, run int, n_train bigint, n_test bigint, accuracy double")


def perceptron(df: DataFrame, layers: Sequence[int], seed: int, rounds: int = 50, label: str = "label"):
    """A feed-forward classifier; the last layer gives class probabilities."""
    return MultilayerPerceptronClassifier(
        layers=list(layers), featuresCol="features", labelCol=label, maxIter=rounds, seed=seed
    ).fit(df)


def cluster_table(df: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """``(keys, x, y, cluster)``: plane coordinates and cluster of every row."""
    plane = projected(clusters(df, k, seed), 2)
    xy = vector_to_array("pca")
    return plane.select(*keys, xy[0].alias("x"), xy[1].alias("y"), "cluster")
