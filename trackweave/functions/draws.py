"""Reproducible pseudo-random values derived from keys.

A value depends only on the seed and the key, never on partitioning or on the
order in which tasks run, so a lost executor recomputes the very same draw and
another engine can check the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

HEX_DIGITS = 13  # 52 bits: every value is an exact double
SPAN = float(16**HEX_DIGITS)


def _col(key) -> Column:
    return key if isinstance(key, Column) else F.col(key)


def digest(seed, *keys) -> Column:
    """md5 text of the seed and the keys, as a random but fixed sort key."""
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def draw(seed, *keys) -> Column:
    """A whole number in [0, 2**52)."""
    return F.conv(F.substring(digest(seed, *keys), 1, HEX_DIGITS), 16, 10).cast("bigint")


def draw_below(n, seed, *keys) -> Column:
    """A whole number in [0, n)."""
    return F.pmod(draw(seed, *keys), _col(n) if isinstance(n, str) else n)


def uniform(seed, *keys) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *keys) / F.lit(SPAN)


def normal(seed, *keys) -> Column:
    """A standard normal value, from two uniform ones."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, F.lit("radius"), *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, F.lit("angle"), *keys))
