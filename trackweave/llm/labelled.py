"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = 1 << 30


def sampled(doc_id: Column, share: float, seed: str) -> Column:
    """Whether an id belongs to a fixed sample with the given share of all ids."""
    draw = F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("string")), F.lit(SPAN))
    return draw < F.lit(int(min(1.0, share) * SPAN))


def bounded(labels: DataFrame, column: str, most: int, seed: str) -> tuple[DataFrame, float]:
    """About ``most`` ids with their label, and the share that the sample takes of all.

    A repeated id counts once, with its smallest label; null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    known = known.groupBy("doc_id").agg(F.min(column).cast("double").alias("label"))
    n = known.count()
    share = 1.0 if n <= most else most / n
    return known.where(sampled(F.col("doc_id"), share, seed)), share
