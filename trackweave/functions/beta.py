"""Beta-distributed values out of keyed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from trackweave.functions.draws import uniform

MOST_ALPHA = 2.0


def attempts(alpha: float) -> int:
    """So many tries that all of them fail less than once in 10**15 values."""
    if not 0 < alpha <= MOST_ALPHA:
        raise ValueError(f"alpha must be above 0 and at most {MOST_ALPHA}")
    accepted = math.exp(2 * math.lgamma(alpha + 1) - math.lgamma(2 * alpha + 1))
    return 1 if accepted > 1 - 1e-15 else math.ceil(-15 * math.log(10) / math.log1p(-accepted))


def beta(alpha: float, seed, *keys) -> Column:
    """A Beta(alpha, alpha) value fixed by the seed and the keys.

    Two uniform values to the power of ``1 / alpha`` that add up to at most 1 give the value as the
    share of the first one; the first try that does so counts. The tries are draws of digests like all
    others, in columns, so another engine can follow them.
    """

    def one(i: Column) -> Column:
        power = F.lit(1.0 / alpha)
        return F.struct(
            F.pow(uniform(seed, F.lit("first"), *keys, i), power).alias("x"), F.pow(uniform(seed, F.lit("second"), *keys, i), power).alias("y")
        )

    tries = F.transform(F.sequence(F.lit(0), F.lit(attempts(alpha) - 1)), one)
    first = F.get(F.filter(tries, lambda t: (t["x"] + t["y"] <= 1) & (t["x"] + t["y"] > 0)), F.lit(0))
    return F.coalesce(first["x"] / (first["x"] + first["y"]), F.lit(0.5))
