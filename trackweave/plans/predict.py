"""Scoring of windows and the filled submission grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trackweave.functions.project import linear_map
from trackweave.functions.vectors import dot
from trackweave.operators.labels import classes_above, fill_grid, top_classes
from trackweave.operators.metrics import mean_vector
from trackweave.operators.numbering import with_each


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``(label, centroid)``: the mean vector per class."""
    return (
        mean_vector(df, [label], vector)
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("_m"))
        .select(F.col(label).alias("label"), F.transform("_m", lambda s: s["mean"]).alias("centroid"))
    )


def centroid_scores(
    df: DataFrame, keys: Sequence[str], vector: str, centres: DataFrame, max_classes: int = 10_000
) -> DataFrame:
    """``(keys, scores)``: the inner product with every class mean, by class order.

    Up to ``max_classes`` means are a model that goes to the tasks; more of them
    stay a table that the rows are joined with.
    """
    model = centres.orderBy("label").limit(max_classes + 1).collect()
    if len(model) <= max_classes:
        weights = np.array([r.centroid for r in model]).T
        return linear_map(df, keys, vector, weights).select(
            *keys, F.transform("z", lambda v: F.round(v, 9)).alias("scores")
        )
    named = centres.withColumnsRenamed({"label": "_class", "centroid": "_centre"})
    paired = with_each(df.select(*keys, vector), named, by=keys)
    return (
        paired.select(*keys, "_class", F.round(dot(F.col(vector), F.col("_centre")), 9).alias("s"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_class", "s"))).alias("_s"))
        .select(*keys, F.transform("_s", lambda x: x["s"]).alias("scores"))
    )


def predicted_rows(
    scored: DataFrame, classes: DataFrame, method: str = "top", sentinel: str = "noise"
) -> DataFrame:
    """``(file_id, end_time, bird, target)``: the classes named for each window.

    ``top`` names the best class, ``top-not-noise`` all above the sentinel.
    """
    keys = ["file_id", "end_time"]
    if method == "top":
        named = top_classes(scored, "scores", keys, 1)
    elif method == "top-not-noise":
        at = classes.where(F.col("label") == sentinel).agg(F.max("idx")).scalar()
        with_at = scored.withColumn("_at", at)
        named = classes_above(with_at, "scores", keys, F.col("_at"))
    else:
        raise ValueError("method must be top or top-not-noise")
    return named.join(classes, "idx").select(
        *keys, F.col("label").alias("bird"), F.lit(True).alias("target")
    )


def evaluation_grid(windows: DataFrame, classes: DataFrame, truth: str | None = None) -> DataFrame:
    """Windows times classes with ``row_id`` and, given ``truth``, a flag.

    The window at time 0 is left out.
    """
    names = classes.select(F.col("label").alias("bird"))
    grid = with_each(windows.where("end_time <> 0"), names, by=["file_id", "end_time"])
    keyed = grid.withColumn(
        "row_id", F.concat_ws("_", F.col("file_id").cast("string"), "bird", F.col("end_time").cast("string"))
    )
    return keyed if truth is None else keyed.withColumn("label", F.col("bird") == F.col(truth))


def submission(grid: DataFrame, predictions: DataFrame, sentinel: str) -> DataFrame:
    """``(row_id, target)`` for every grid row."""
    filled = fill_grid(grid, predictions, ["file_id", "bird", "end_time"], sentinel)
    return filled.select("row_id", "target")
