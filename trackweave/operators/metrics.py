"""Scores of predictions and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.functions.vectors import distance, norm
from trackweave.operators.quantiles import exact_quantiles, with_group


def class_scores(rows: DataFrame, by: str, truth: Column, predicted: Column) -> DataFrame:
    """True and false positives, precision, recall and F1 per class in one pass.

    All three are 0 for a class without true positives.
    """
    tp, fp, fn = truth & predicted, ~truth & predicted, truth & ~predicted
    counts = rows.groupBy(by).agg(
        F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn")
    )
    none = F.col("tp") == 0
    precision = F.when(none, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(none, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.when(none, 0.0).otherwise(
        2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    )
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1})


def roc_auc(rows: DataFrame, score: str, label: str, bucket: Column) -> DataFrame:
    """``(auc)``: area under the ROC curve, ties counted half.

    Rows are counted per distinct score first. ``bucket`` must not decrease with
    the score; running sums stay inside a bucket and start from bucket totals.
    """
    per_score = (
        rows.withColumn("_b", bucket)
        .groupBy("_b", score)
        .agg(
            F.sum(F.col(label).cast("bigint")).alias("pos"),
            F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
        )
    )
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_score.groupBy("_b")
        .agg(F.sum("neg").alias("_neg"))
        .select("_b", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_score.withColumn("_low", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(
        starts, "_b"
    )
    won = F.sum(F.col("pos") * (F.col("_start") + F.col("_low") + F.col("neg") / 2))
    return placed.agg((won / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def described(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Count, sum, mean, sample deviation, minimum, quartiles and maximum.

    Counts, sums and quantiles are all combined before the shuffle; no row is exchanged.
    """
    basic = df.groupBy(*groups).agg(
        F.count(value).alias("count"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quart = exact_quantiles(df, groups, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return with_group(basic, quart, list(groups))


def histogram(df: DataFrame, value: Column, low: Column, high: Column, bins: int) -> DataFrame:
    """``(bin, n)``: counts in equal bins, the top edge in the last one."""
    at = F.floor((value - low) / (high - low) * bins)
    kept = df.where((value >= low) & (value <= high))
    return kept.groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def mean_vector(df: DataFrame, groups: Sequence[str], vector: str) -> DataFrame:
    """``(groups, dim, mean)``: element-wise means; sums are combined map-side."""
    return (
        df.select(*groups, F.posexplode(vector).alias("dim", "_v"))
        .groupBy(*groups, "dim")
        .agg(F.avg(F.col("_v").cast("double")).alias("mean"))
    )


def triplet_loss(
    df: DataFrame, anchor: Column, near: Column, far: Column, margin: float = 50, l2: float = 0.01
) -> DataFrame:
    """Mean margin loss with a norm penalty, and its parts."""
    rows = df.select(
        distance(anchor, near).alias("_n"),
        distance(anchor, far).alias("_d"),
        (norm(anchor) + norm(near) + norm(far)).alias("_p"),
    )
    gap = F.col("_n") - F.col("_d")
    return rows.agg(
        F.avg(F.greatest(gap + margin, F.lit(0.0)) + l2 * F.col("_p")).alias("loss"),
        F.avg("_n").alias("near"),
        F.avg("_d").alias("far"),
        F.avg(gap).alias("gap"),
    )


def cross_entropy(p: Column, y: Column) -> Column:
    """Binary cross-entropy of one prediction, logarithms not below -100."""
    def safe_log(q: Column) -> Column:
        return F.when(q > 0, F.greatest(F.log(q), F.lit(-100.0))).otherwise(F.lit(-100.0))

    return -(y * safe_log(p) + (1 - y) * safe_log(1 - p))
