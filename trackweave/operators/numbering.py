"""Dense numbering of rows without sorting a whole group in one task.

``row_number`` over a group sorts that group in one task. Here a group is cut
into buckets that follow the sort order, rows are numbered inside each bucket,
and the number of rows in earlier buckets is added. Only the table of bucket
counts is ever ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.functions.draws import digest


def number_rows(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    name: str = "row_idx",
    total: str | None = None,
) -> DataFrame:
    """Number rows 0, 1, 2, ... per group in the given order.

    ``bucket`` must not decrease along the order. ``groups`` may be empty for a
    numbering over the whole table. ``total`` names a column for the group size.
    """
    # one struct key: null groups match, and the join reuses the window's shuffle
    tagged = df.withColumn("_key", F.struct(*groups, bucket.alias("_bucket")))
    before = (
        Window.partitionBy(*[F.col("_key")[g] for g in groups])
        .orderBy(F.col("_key")["_bucket"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extra = [] if total is None else [F.sum("_n").over(whole).alias(total)]
    offsets = (
        tagged.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *extra)
    )
    inside = Window.partitionBy("_key").orderBy(*order)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_key")
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("bigint"))
        .drop("_key", "_rn", "_before")
    )


def number_shuffled(
    df: DataFrame,
    groups: Sequence[str],
    seed,
    keys: Sequence[str],
    name: str = "row_idx",
    total: str | None = None,
    bucket_digits: int = 3,
) -> DataFrame:
    """Number rows per group in a fixed random order given by the unique keys.

    The leading hex digits of the digest are the buckets, so even one huge group
    spreads evenly over ``16 ** bucket_digits`` tasks.
    """
    return number_rows(
        df.withColumn("_digest", digest(seed, *keys)),
        groups,
        ["_digest", *keys],
        F.substring("_digest", 1, bucket_digits),
        name,
        total,
    ).drop("_digest")


def group_offsets(df: DataFrame, group: str) -> DataFrame:
    """Rows per group with the rows in earlier groups and in all groups.

    The result has one row per group; groups are classes or families.
    """
    by_name = Window.orderBy(group)
    return (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n_group"))
        .withColumn(
            "group_start",
            F.coalesce(
                F.sum("n_group").over(by_name.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .withColumn(
            "n_all",
            F.sum("n_group").over(
                by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
        .withColumn(
            "n_groups",
            F.count(F.lit(1)).over(
                by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
    )


def with_each(
    rows: DataFrame, small: DataFrame, salts: int = 32, by: Sequence[str] | None = None
) -> DataFrame:
    """Pair every row with every row of a short list, as an equi-join.

    The list is repeated once per salt and rows carry a salt out of the columns
    ``by``, so Spark can broadcast the list where it is small and otherwise
    shuffle both sides evenly.
    """
    salt = F.pmod(F.xxhash64(*(by or rows.columns)), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", salt)
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, "_salt").drop("_salt")


def repeat_rows(df: DataFrame, times: Column, name: str = "draw", block: int = 10_000) -> DataFrame:
    """Repeat each row ``times`` times, numbered 0, 1, ... in ``name``.

    The numbers are produced block by block, so that one row asking for many
    repeats is spread over tasks.
    """
    blocks = F.when(times > 0, F.sequence(F.lit(0), F.floor((times - 1) / block).cast("int")))
    first = F.col("_block").cast("bigint") * block
    last = F.least(first + block - 1, times.cast("bigint") - 1)
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn(name, F.explode(F.sequence(first, last)))
        .drop("_block")
    )
