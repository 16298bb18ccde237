"""Reproducible sampling, balancing and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.functions.draws import digest, draw_below, uniform
from trackweave.operators.numbering import number_shuffled, repeat_rows
from trackweave.session import cut_lineage

# from here on Spark ranks whole groups instead of each task's first rows
_LARGE_K = 1000


def bernoulli_by_group(
    df: DataFrame, group: str, fractions: DataFrame, seed, keys: Sequence[str]
) -> DataFrame:
    """Keep each row with the probability given for its group.

    ``fractions`` has one row ``(group, fraction)`` per group.
    """
    return (
        df.join(fractions, group)
        .where(uniform(seed, *keys) < F.col("fraction"))
        .drop("fraction")
    )


def bernoulli_by_generator(df: DataFrame, group: str, fractions: dict, seed: int) -> DataFrame:
    """The same kind of sample by Spark's own generator.

    It takes its fractions from the driver; groups without one are left out. For fractions
    kept in a table use ``bernoulli_by_group``.
    """
    return df.sampleBy(group, fractions, seed)


def sample_with_replacement(
    df: DataFrame, group: str, k: int, seed, keys: Sequence[str]
) -> DataFrame:
    """Exactly ``k`` rows per group, drawn with replacement, with their ``draw``.

    Members are numbered and draws pick numbers, so the join is on
    ``(group, number)`` and spreads evenly however uneven the groups are. Only the group and the unique ``keys`` are
    numbered; what else a row has is fetched for the picks alone. They are written before, so Spark knows
    how few they are and need not move the rows that nobody picked.
    """
    known = df.where(F.col(group).isNotNull())
    names = list(dict.fromkeys([group, *keys]))
    members = number_shuffled(known.select(*names), [group], seed, keys)
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    draws = repeat_rows(sizes, F.lit(k)).select(
        group, "draw", draw_below("_n", seed, F.lit("pick"), group, "draw").alias("row_idx")
    )
    picks = draws.join(members, [group, "row_idx"]).drop("row_idx")
    payload = [c for c in df.columns if c not in names]
    if not payload:
        return picks
    return known.join(cut_lineage(picks), names).select(group, "draw", *[c for c in df.columns if c != group])


def sample_without_replacement(
    df: DataFrame, groups: Sequence[str], k: int, seed, keys: Sequence[str]
) -> DataFrame:
    """At most ``k`` distinct rows per group (or of the whole table)."""
    if k >= _LARGE_K:
        numbered = number_shuffled(df, groups, seed, keys, "_i")
        return numbered.where(F.col("_i") < k).drop("_i")
    ordered = df.withColumn("_digest", digest(seed, *keys))
    if not groups:
        return ordered.orderBy("_digest", *keys).limit(k).drop("_digest")
    return first_per_group(ordered, groups, ["_digest", *keys], k).drop("rank", "_digest")


def first_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int, salts: int = 256
) -> DataFrame:
    """The first ``k`` rows per group in the given order, ranked from 1.

    For a small ``k`` every task keeps only its own first rows of each group
    before the shuffle. For a large one Spark does not, so the first rows of
    each salted part of a group are taken before those of the group.
    """
    if k >= _LARGE_K:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        part = Window.partitionBy(*groups, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= k).drop("_rn", "_salt")
    by = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def shuffled(df: DataFrame, seed, keys: Sequence[str], name: str = "index") -> DataFrame:
    """Number all rows in a fixed random order."""
    return number_shuffled(df, [], seed, keys, name)


def split_two(
    df: DataFrame, train: float, seed, keys: Sequence[str], strata: Sequence[str] = ()
) -> DataFrame:
    """Add ``split``: the first ``floor(train * n)`` shuffled rows are ``train``."""
    numbered = number_shuffled(df, strata, seed, keys, "_i", "_n")
    cut = F.floor(F.lit(train) * F.col("_n"))
    return numbered.withColumn(
        "split", F.when(F.col("_i") < cut, "train").otherwise("test")
    ).drop("_i", "_n")


def split_three(df: DataFrame, train: float, seed, keys: Sequence[str]) -> DataFrame:
    """Add ``split``: ``train``, and the rest halved into ``val`` and ``test``."""
    numbered = number_shuffled(df, [], seed, keys, "_i", "_n")
    first = F.floor(F.lit(train) * F.col("_n"))
    second = first + F.floor((F.col("_n") - first) * 0.5)
    return numbered.withColumn(
        "split",
        F.when(F.col("_i") < first, "train").when(F.col("_i") < second, "val").otherwise("test"),
    ).drop("_i", "_n")


def split_lengths(
    df: DataFrame, ratios: Sequence[float], seed, keys: Sequence[str]
) -> DataFrame:
    """Add ``part``: parts of ``floor(ratio * n)`` rows, the remainder to part 0."""
    numbered = number_shuffled(df, [], seed, keys, "_i", "_n")
    sizes = [F.floor(F.col("_n") * F.lit(r)) for r in ratios]
    end = F.col("_n") - sum(sizes[1:], F.lit(0))
    part = F.when(F.col("_i") < end, 0)
    for number, size in enumerate(sizes[1:], start=1):
        end = end + size
        part = part.when(F.col("_i") < end, number)
    return numbered.withColumn("part", part).drop("_i", "_n")


def folds(df: DataFrame, k: int, seed, keys: Sequence[str], name: str = "fold") -> DataFrame:
    """Add a random fold number below ``k``."""
    return df.withColumn(name, draw_below(F.lit(k), seed, *keys).cast("int"))


def random_offset(seconds: Column, window: float, u: Column) -> Column:
    """A random place for a window inside a track, -1 where it does not fit."""
    return F.when(seconds <= window, F.lit(-1.0)).otherwise(u * (seconds - window) + window / 2)


def inverse_frequency(counts: DataFrame, group: str, n: str = "n") -> DataFrame:
    """``(group, weight, fraction)``: weights sum to 1, fractions for sampling.

    Fractions are weights times ``floor(1 / largest weight)``. ``counts`` has one
    row per group.
    """
    everything = Window.partitionBy()
    return (
        counts.withColumn("_inv", F.sum(n).over(everything) / F.col(n))
        .withColumn("weight", F.col("_inv") / F.sum("_inv").over(everything))
        .withColumn("fraction", F.col("weight") * F.floor(1 / F.max("weight").over(everything)))
        .select(group, "weight", "fraction")
    )


def balanced_weights(df: DataFrame, group: str) -> DataFrame:
    """``(group, n, weight)`` with weight ``n_all / (n_classes * n)``."""
    everything = Window.partitionBy()
    return (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "weight",
            F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")),
        )
    )
