"""Class lists, encodings and rankings of class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def class_table(labels: DataFrame, label: str = "label", extra: Sequence[str] = ()) -> DataFrame:
    """``(label, idx)``: the distinct labels and extra ones, sorted, from 0.

    One row per class; the list of classes is the dimension of a model.
    """
    known = labels.select(F.col(label).alias("label")).where("label is not null")
    for name in extra:
        known = known.unionByName(labels.sparkSession.range(1).select(F.lit(name).alias("label")))
    by_name = Window.orderBy("label")
    return known.distinct().select(
        "label", (F.row_number().over(by_name) - 1).cast("int").alias("idx")
    )


def in_list(df: DataFrame, column: str, names: DataFrame, name: str = "label") -> DataFrame:
    """Rows whose value is in the list."""
    return df.join(names.select(F.col(name).alias(column)).distinct(), column, "left_semi")


def others_collapsed(
    df: DataFrame, column: str, names: DataFrame, name: str = "label", other: str = "other"
) -> DataFrame:
    """Replace values outside the list by ``other``, unless the list is empty."""
    known = names.select(F.col(name).alias(column)).distinct().withColumn("_known", F.lit(True))
    any_name = names.agg(F.count(F.lit(1)) > 0).scalar()
    return (
        df.join(known, column, "left")
        .withColumn(
            column,
            F.when(F.col("_known").isNull() & any_name, F.lit(other)).otherwise(F.col(column)),
        )
        .drop("_known")
    )


def ranked_classes(scores: Column) -> Column:
    """The class numbers of a score vector, best first.

    Equal scores put the higher class number first. Works inside the row, so
    ranking needs no shuffle.
    """
    tagged = F.transform(
        scores, lambda v, i: F.struct(v.cast("double").alias("score"), i.cast("int").alias("idx"))
    )
    return F.sort_array(tagged, asc=False)


def class_ranks(df: DataFrame, scores: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, rank, idx, score)``: every class of every row, rank from 1."""
    return df.select(
        *keys, F.posexplode(ranked_classes(F.col(scores))).alias("_p", "_c")
    ).select(*keys, (F.col("_p") + 1).alias("rank"), "_c.idx", "_c.score")


def top_classes(df: DataFrame, scores: str, keys: Sequence[str], k: int) -> DataFrame:
    """The best ``k`` classes of every row."""
    return df.select(
        *keys, F.posexplode(F.slice(ranked_classes(F.col(scores)), 1, k)).alias("_p", "_c")
    ).select(*keys, (F.col("_p") + 1).alias("rank"), "_c.idx", "_c.score")


def classes_above(
    df: DataFrame, scores: str, keys: Sequence[str], sentinel: Column
) -> DataFrame:
    """The classes scored above the sentinel class, best first."""
    ranked = ranked_classes(F.col(scores))
    at = F.array_position(F.transform(ranked, lambda c: c["idx"]), sentinel)
    better = F.when(at > 0, F.slice(ranked, F.lit(1), (at - 1).cast("int"))).otherwise(ranked)
    return df.select(*keys, F.posexplode(better).alias("_p", "_c")).select(
        *keys, (F.col("_p") + 1).alias("rank"), "_c.idx", "_c.score"
    )


def positive_labels(
    df: DataFrame, target: str, keys: Sequence[str], classes: DataFrame
) -> DataFrame:
    """``(keys, label)``: the classes with a non-zero entry in a target vector."""
    hits = df.select(*keys, F.posexplode(F.col(target)).alias("idx", "_v")).where("_v <> 0")
    return hits.join(classes, "idx").select(*keys, "label")


def fill_grid(
    grid: DataFrame, positives: DataFrame, keys: Sequence[str], sentinel: str
) -> DataFrame:
    """Grid rows with ``target``: whether a prediction names the row.

    Predictions of the sentinel class are dropped; missing ones are false.
    """
    named = positives.where(F.col("bird") != sentinel).select(*keys, "target")
    return grid.join(named, list(keys), "left").withColumn(
        "target", F.coalesce("target", F.lit(False))
    )
