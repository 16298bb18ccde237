"""Element-wise functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(x: Column) -> Column:
    """Sum of the elements."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def squared_norm(a: Column) -> Column:
    return total(F.transform(a, lambda v: v.cast("double") * v.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(
        total(
            F.zip_with(
                a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
            )
        )
    )


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sigmoid(x: Column) -> Column:
    return F.transform(x, lambda v: 1 / (1 + F.exp(-v.cast("double"))))


def one_hot(index: Column, k: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), k.cast("int") - 1), lambda i: F.when(i == index, 1).otherwise(0)
    )


def gain(x: Column, decibel: Column) -> Column:
    return F.transform(x, lambda v: v * F.pow(F.lit(10.0), decibel / 20))


def rotate(x: Column, by: Column) -> Column:
    """Shift right by ``by`` places, wrapping round; negative shifts go left."""
    n = F.size(x)
    s = F.pmod(by.cast("int"), n)
    return F.when(n == 0, x).otherwise(
        F.concat(F.slice(x, n - s + 1, s), F.slice(x, F.lit(1), n - s))
    )


def crop(x: Column, offset: Column, width: int) -> Column:
    return F.slice(x, (offset + 1).cast("int"), F.lit(width))


def mix(a: Column, b: Column, weight: Column) -> Column:
    """``a * weight + b * (1 - weight)`` element by element."""
    return F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight))


def mean_square(x: Column) -> Column:
    return squared_norm(x) / F.size(x)


def noise_scale(x: Column, snr_db: Column) -> Column:
    """Standard deviation of white noise at the wanted signal-to-noise ratio."""
    return F.sqrt(mean_square(x) / F.pow(F.lit(10.0), snr_db / 10))


def with_noise(x: Column, scale: Column, unit_noise: Column) -> Column:
    """Add ``scale`` times an array of standard normal values."""
    return F.zip_with(x, unit_noise, lambda v, e: v + scale * e)
