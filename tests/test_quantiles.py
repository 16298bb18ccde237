"""Quantiles by counting, against sorting."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators.quantiles import SHIFTS, exact_quantiles, ordered_bits

PROBS = {"low": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p999": 0.999, "high": 1.0}


def bits(x: float) -> int:
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_bits_are_those_of_the_double(spark):
    rng = np.random.default_rng(4)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf]
    values += [float(np.nextafter(2.0**e, d)) for e in range(-1070, 1023, 13) for d in (0.0, math.inf)]
    values += [2.0**e for e in range(-1074, 1024, 7)] + rng.normal(size=500).tolist() + (10.0 ** rng.uniform(-300, 300, 500)).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", ordered_bits(F.col("v")))
    for r in df.collect():
        assert r["b"] == bits(r["v"]), r["v"]
    assert spark.range(1).select(ordered_bits(F.lit(float("nan")))).first()[0] > bits(math.inf)


@pytest.mark.parametrize("few", [1, 4096])
def test_one_large_group(spark, few):
    """Three hundred thousand rows of one group, many of them equal."""
    df = spark.range(300_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 7.25).otherwise((F.xxhash64("id") % 1_000_003) / 977.0).alias("v")
    )
    values = np.array([r["v"] for r in df.collect()])
    got = exact_quantiles(df, [], "v", PROBS, few).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-15), name


def test_groups_null_groups_and_ties(spark):
    rng = np.random.default_rng(9)
    rows = [(None if g == 3 else f"g{g}", float(v)) for g in range(5) for v in rng.integers(-4, 5, 40 * g + 1)]
    rows += [("empty", None), ("g0", None), ("edge", -math.inf), ("edge", math.inf), ("edge", 1.5), ("tiny", 5e-324), ("tiny", -5e-324), ("tiny", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", PROBS, 2).collect()}
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g in want:
        if g != "edge":
            for name, p in PROBS.items():
                assert got[g][name] == pytest.approx(np.quantile(want[g], p), abs=1e-12), (g, name)
    assert [got["edge"][n] for n in ("low", "p50", "high")] == [-math.inf, 1.5, math.inf]
    assert got["tiny"]["p50"] == 0.0


def test_rows_are_not_exchanged(spark):
    """With broadcasts off only counts go through the exchanges of the first pass."""
    from trackweave.operators import quantiles

    rows = spark.range(50_000, numPartitions=8).select(F.struct(F.lit(0)).alias("_key"), F.lit(0).cast("bigint").alias("_bin"), ordered_bits(F.col("id") * 1.0).alias("_bits"))
    bins = quantiles._bins(rows, SHIFTS[0])
    assert bins.agg(F.sum("_c")).first()[0] == 50_000
    assert bins.count() < 100
