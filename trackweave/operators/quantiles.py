"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. Here the wanted ranks are
found by counting: a double has a whole number of 64 bits that is ordered as it is, and each
pass counts the rows of a group by the next 13 bits of that number, in the bins that still
hold a wanted rank only. Counts are combined before the shuffle, so no row is exchanged and a
group of any share of the rows is as good as any other. After at most five passes a bin is
one value; as soon as no bin holds more than ``FEW`` rows, their values are ranked at once. Every step is
the same at every size, and exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.session import cut_lineage

SHIFTS = (51, 38, 25, 12, 0)
FEW = 4096


def with_group(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the facts of each row's group; null groups match, no keys mean one group."""
    names = [c for c in facts.columns if c not in keys]
    if not keys:
        one = facts.select(F.struct(*names)).scalar()
        return rows.withColumn("_facts", one).select(
            *rows.columns, *[F.col("_facts")[n].alias(n) for n in names]
        )
    named = facts.select(F.struct(*keys).alias("_key"), *names)
    return rows.withColumn("_key", F.struct(*keys)).join(named, "_key").drop("_key")


def ordered_bits(x: Column) -> Column:
    """A whole number for every double, ordered as doubles are; equal for both zeros, highest for NaN."""
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("int")
    # the logarithm may be off by one next to powers of two
    low = F.when(size < F.pow(F.lit(2.0), guess), 1).otherwise(0)
    high = F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0)
    exponent = guess - low + high
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("bigint")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    top = F.lit(2047 << 52)
    bits = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size < F.lit(2.0**-1022), tiny)
        .when(size == F.lit(float("inf")), top)
        .otherwise((exponent + 1023).cast("bigint") * F.lit(1 << 52) + fraction)
    )
    return F.when(F.isnan(x), top + 1).when(x < 0, -bits).otherwise(bits)


def _bins(rows: DataFrame, shift: int) -> DataFrame:
    """``(_key, _bin, _next, _c, _upto)``: rows by the next bits, and their number up to there in the bin before.

    A bin has at most 8 192 next ones.
    """
    counted = rows.groupBy("_key", "_bin", F.shiftright("_bits", shift).alias("_next")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_key", "_bin").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_upto", F.sum("_c").over(upto))


def _placed(wanted: DataFrame, bins: DataFrame) -> DataFrame:
    """The wanted ranks inside the next bins: ``(_key, _bin, _t, _r, _c, weight)``."""
    inside = (F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c"))
    met = wanted.drop("_c").join(bins, ["_key", "_bin"]).where(inside)
    return met.select("_key", F.col("_next").alias("_bin"), "_t", (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_r"), "_c", "_w")


def _within(rows: DataFrame, wanted: DataFrame, shift: int) -> DataFrame:
    """The rows of the bins that hold a wanted rank; there are at most as many bins as ranks."""
    bins = wanted.select("_key", "_bin").distinct()
    return rows.withColumn("_bin", F.shiftright("_bits", shift)).join(bins, ["_key", "_bin"])


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], few: int = FEW) -> DataFrame:
    """One row per group with the linearly interpolated quantiles in ``probs``.

    Null values do not count; a group without values has no row. ``df`` is read once for every pass.
    """
    rows = df.select(
        F.struct(F.lit(0), *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]).alias("_key"),
        F.col(value).cast("double").alias("_v"),
    ).where("_v IS NOT NULL")
    rows = rows.select("_key", "_v", ordered_bits(F.col("_v")).alias("_bits"))
    first = cut_lineage(_bins(rows.withColumn("_bin", F.lit(0).cast("bigint")), SHIFTS[0]))
    sizes = first.groupBy("_key").agg(F.sum("_c").alias("_n"))
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = [
        F.struct(F.lit(2 * i + j).alias("_t"), edge(place(p)).cast("bigint").alias("_r"), (place(p) - F.floor(place(p))).alias("_w"))
        for i, p in enumerate(probs.values())
        for j, edge in enumerate((F.floor, F.ceil))
    ]
    wanted = sizes.select("_key", F.lit(0).cast("bigint").alias("_bin"), F.explode(F.array(*ranks)).alias("_s"))
    wanted = wanted.select("_key", "_bin", "_s.*").withColumn("_c", F.lit(0))
    wanted = cut_lineage(_placed(wanted, first))
    shift = SHIFTS[0]
    for finer in SHIFTS[1:]:
        if (wanted.agg(F.max("_c").alias("c")).first()["c"] or 0) <= few:
            break
        wanted = cut_lineage(_placed(wanted, _bins(_within(rows, wanted, shift), finer)))
        shift = finer
    # bins of few rows, or of a single value
    values = _within(rows, wanted, shift).groupBy("_key", "_bin", F.col("_v").alias("_next")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_key", "_bin").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
    found = _placed(wanted, values.withColumn("_upto", F.sum("_c").over(upto)))
    edges = found.groupBy("_key").agg(
        *[F.max(F.when(F.col("_t") == t, F.col("_bin"))).alias(f"_e{t}") for t in range(2 * len(probs))],
        *[F.max(F.when(F.col("_t") == 2 * i, F.col("_w"))).alias(f"_w{i}") for i in range(len(probs))],
    )
    between = lambda a, b, w: F.when(a == b, a).otherwise(a + (b - a) * w)
    return edges.select(
        *[F.col("_key")[f"g{i}"].alias(g) for i, g in enumerate(groups)],
        *[between(F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}"), F.col(f"_w{i}")).alias(n) for i, n in enumerate(probs)],
    )
