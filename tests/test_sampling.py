"""Numbering, sampling, splitting, batching and pairing."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions.beta import beta
from trackweave.operators import batches, pairing, sampling
from trackweave.operators.numbering import number_rows, number_shuffled, repeat_rows, with_each


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; some rows have no group."""
    group = F.when(F.col("id") < 700, "big").when(F.col("id") < 900, "mid").when(F.col("id") < 990, "small")
    return spark.range(1000).select("id", group.alias("grp"))


def test_numbering_follows_the_order(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("v"), (F.col("id") % 2).alias("g"))
    got = number_rows(df, ["g"], ["v"], F.expr("v div 13"), "i", "n")
    for g in (0, 1):
        rows = sorted((r.i, r.v) for r in got.where(f"g = {g}").collect())
        assert [i for i, _ in rows] == list(range(250))
        assert [v for _, v in rows] == sorted(v for _, v in rows)
    assert got.select("n").distinct().collect()[0].n == 250


def test_numbering_keeps_rows_without_group(skewed):
    got = number_shuffled(skewed, ["grp"], 1, ["id"]).collect()
    assert len(got) == 1000
    for name, n in (("big", 700), ("mid", 200), ("small", 90), (None, 10)):
        assert sorted(r.row_idx for r in got if r.grp == name) == list(range(n))


def test_numbering_over_everything(skewed):
    got = number_shuffled(skewed, [], 1, ["id"]).collect()
    assert sorted(r.row_idx for r in got) == list(range(1000))
    assert [r.id for r in sorted(got, key=lambda r: r.row_idx)] != list(range(1000))


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 25)], "k string, n int")
    got = Counter((r.k, r.draw) for r in repeat_rows(df, F.col("n"), block=10).collect())
    assert got == Counter([("b", 0)] + [("c", i) for i in range(25)])


def test_with_each(spark):
    got = with_each(spark.range(50), spark.createDataFrame([("x",), ("y",)], "c string"), by=["id"])
    assert Counter((r.id, r.c) for r in got.collect()) == Counter((i, c) for i in range(50) for c in "xy")


def test_with_replacement(skewed):
    got = sampling.sample_with_replacement(skewed, "grp", 120, 5, ["id"]).collect()
    assert Counter(r.grp for r in got) == {"big": 120, "mid": 120, "small": 120}
    # more draws than rows: some row comes twice
    assert max(Counter(r.id for r in got if r.grp == "small").values()) > 1
    again = sampling.sample_with_replacement(skewed.repartition(7), "grp", 120, 5, ["id"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_without_replacement(skewed):
    got = sampling.sample_without_replacement(skewed.where("grp is not null"), ["grp"], 95, 5, ["id"]).collect()
    assert Counter(r.grp for r in got) == {"big": 95, "mid": 95, "small": 90}
    assert len({r.id for r in got}) == len(got)
    assert sampling.sample_without_replacement(skewed, [], 10, 5, ["id"]).count() == 10


def test_many_per_group(spark):
    """From a thousand on the first rows are found in two steps."""
    df = spark.range(6000).select("id", (F.col("id") % 6 == 0).alias("g"))
    got = sampling.first_per_group(df, ["g"], [F.desc("id")], 1500, salts=8).collect()
    assert Counter(r.g for r in got) == {True: 1000, False: 1500}
    ids = [r.id for r in sorted((r for r in got if not r.g), key=lambda r: r["rank"])]
    assert ids == [i for i in range(5999, -1, -1) if i % 6][:1500]
    some = sampling.sample_without_replacement(df, ["g"], 1500, 1, ["id"]).collect()
    assert Counter(r.g for r in some) == {True: 1000, False: 1500} and len({r.id for r in some}) == 2500


def test_splits(skewed):
    two = Counter(r.split for r in sampling.split_two(skewed, 0.9, 1, ["id"]).collect())
    assert two == {"train": 900, "test": 100}
    three = Counter(r.split for r in sampling.split_three(skewed.where("id < 995"), 0.8, 1, ["id"]).collect())
    assert three == {"train": 796, "val": 99, "test": 100}
    parts = Counter(r.part for r in sampling.split_lengths(skewed.where("id < 10"), [0.9, 0.1], 1, ["id"]).collect())
    assert parts == {0: 9, 1: 1}
    by_group = sampling.split_two(skewed, 0.9, 1, ["id"], ["grp"]).where("split = 'train'")
    assert Counter(r.grp for r in by_group.collect()) == {"big": 630, "mid": 180, "small": 81, None: 9}


def test_weights(skewed):
    counts = skewed.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"))
    got = {r.grp: r for r in sampling.inverse_frequency(counts, "grp").collect()}
    inverse = {"big": 990 / 700, "mid": 990 / 200, "small": 990 / 90}
    total = sum(inverse.values())
    assert all(abs(got[g].weight - inverse[g] / total) < 1e-12 for g in inverse)
    assert abs(got["small"].fraction - inverse["small"] / total * int(total / inverse["small"])) < 1e-12
    balanced = {r.grp: r.weight for r in sampling.balanced_weights(skewed.where("grp is not null"), "grp").collect()}
    assert abs(balanced["big"] - 990 / (3 * 700)) < 1e-12


def test_full_batches(skewed):
    numbered = number_shuffled(skewed.where("grp is not null"), ["grp"], 1, ["id"], "row_idx", "n")
    got = batches.full_batches(numbered, 32)
    sizes = Counter((r.grp, r.batch) for r in got.collect())
    assert set(sizes.values()) == {32}
    assert Counter(g for g, _ in sizes) == {"big": 21, "mid": 6, "small": 2}


def test_worker_ranges(spark):
    got = spark.range(10).select(batches.worker_of(F.col("id"), F.lit(10), 4).alias("w"))
    assert [r.w for r in got.collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_interleave(spark):
    # 3 labels with 2 tracks of 3 windows each, and noise: queues of 4
    rows = [(t, w, "foo bar baz".split()[t // 2]) for t in range(6) for w in range(3)]
    windows = spark.createDataFrame(rows, "track bigint, win_idx bigint, label string")
    got = batches.interleave(windows, 4, 9).orderBy("wave", "round", "slot").collect()
    assert len(got) == (4 * 3 + 1) * 2
    assert Counter(r.label for r in got) == {"foo": 6, "bar": 6, "baz": 6, "noise": 8}
    first = got[:4]
    assert first[0].label == "noise" and len({r.track for r in first[1:]}) == 3
    assert got[12].label == "noise" and got[13].label == "noise"


def test_neighbour_windows(spark):
    rows = [("a", i, p) for i, p in enumerate([10, 12, 25, 21, 3, 40, 41, 4, 5, 9])]
    profile = spark.createDataFrame(rows, "track string, i bigint, pi bigint")
    got = {r.win: r.nbr for r in pairing.window_neighbours(profile, 5).collect()}
    # votes of the first run are 2,2,5,4,0; of the second 8,8,0,1,1: the smaller wins a tie
    assert got == {0: 2, 1: 1}


def test_neighbour_pairs_need_both_windows(spark):
    near = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 5, 0)], "track string, win bigint, nbr bigint")
    windows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "track string, win_idx bigint, x double")
    got = pairing.neighbour_pairs(near, windows).collect()
    assert [(r.anchor_win_idx, r.neighbor_win_idx, r.anchor_x, r.neighbor_x) for r in got] == [(0, 1, 1.0, 2.0)]


def test_three_pairs_per_track(spark):
    """Profile ``[2, 1, 1]`` with window 1 over 3 windows gives 3 pairs a track."""
    profile = spark.range(10).select(
        F.col("id").alias("track"), F.posexplode(F.array(F.lit(2), F.lit(1), F.lit(1))).alias("i", "pi")
    )
    windows = spark.range(30).select(F.expr("id div 3").alias("track"), (F.col("id") % 3).alias("win_idx"))
    near = pairing.window_neighbours(profile, 1)
    assert pairing.neighbour_pairs(near, windows).count() == 30


def test_batch_distants(spark):
    rows = spark.range(64).select(
        F.expr("id div 8").alias("batch"),
        (F.col("id") % 8).cast("int").alias("slot"),
        F.col("id").alias("anchor_x"),
        (F.col("id") + 1000).alias("neighbor_x"),
    )
    got = pairing.batch_distants(rows, ["batch"], 8, 3, ["x"]).collect()
    assert len(got) == 64
    for r in got:
        other = r.distant_x % 1000
        assert other != r.anchor_x and other // 8 == r.batch
    assert len({r.distant_x >= 1000 for r in got}) == 2


def test_members_inside_and_outside(skewed):
    members = pairing.numbered_members(skewed, "grp", 1, ["id"])
    assert sorted(r.member for r in members.collect()) == list(range(990))
    names = {r.member: r.grp for r in members.collect()}
    picked = members.select(
        "grp", pairing.inside_member(2, "id").alias("near"), pairing.outside_member(2, "id").alias("far")
    ).collect()
    assert all(names[r.near] == r.grp and names[r.far] != r.grp for r in picked)


def test_triplets(spark):
    rows = [
        (t, f"f{t % 3}" if t % 10 else None, t % 7, (t % 7) + 20 if t % 4 else None, float(t))
        for t in range(120)
    ]
    df = spark.createDataFrame(
        rows, "track bigint, family string, motif_0 bigint, motif_1 bigint, duration_seconds double"
    )
    got = pairing.triplets(df, 200, 11).collect()
    # 200 // 3 groups // 2 = 33 pairs of each kind and group
    assert len(got) == 2 * 33 * 3
    assert sorted(r["index"] for r in got) == list(range(len(got)))
    family = {t: f for t, f, *_ in rows}
    place = {t: (a, -1 if b is None else b, s) for t, _, a, b, s in rows}
    same = 0
    for r in got:
        assert family[r.a] == family[r.b] == r.family and family[r.c] not in (r.family, None)
        assert r.a_loc == place[r.a][0] and r.b_loc == place[r.b][1]
        s = place[r.c][2]
        assert r.c_loc == place[r.c][0] or r.c_loc == -1 or 3.5 <= r.c_loc <= s - 3.5
        same += r.a == r.b
    assert same >= 99


def test_mixup(spark):
    rows = spark.range(10).select(
        (F.col("id") * 0).alias("batch"),
        F.col("id").cast("int").alias("slot"),
        F.array_repeat(F.col("id").cast("double"), 5).alias("x"),
        F.array(F.col("id").cast("double")).alias("y"),
    )
    got = pairing.mixed_up(rows, ["batch"], 1, F.lit(0.25), ["x", "y"]).collect()
    assert len(got) == 10 and all(len(r.x) == 5 and len(r.y) == 1 for r in got)
    partners = {round((r.y[0] - 0.25 * r.slot) / 0.75) for r in got}
    assert partners == set(range(10))
    assert all(r.x == [r.y[0]] * 5 for r in got)
    lam = [r.v for r in rows.select(beta(0.4, 1, "slot").alias("v")).collect()]
    assert len(set(lam)) == 10 and all(0 <= v <= 1 for v in lam)


@pytest.mark.parametrize("alpha", [0.2, 0.4, 1.0, 2.0])
def test_beta_moments(spark, alpha):
    """Mean 1/2 and variance 1 / (4 (2 alpha + 1)); the same values on a rerun."""
    rows = spark.range(4000, numPartitions=4).select("id", beta(alpha, 5, "id").alias("v"))
    again = spark.range(4000, numPartitions=1).select("id", beta(alpha, 5, "id").alias("v"))
    assert rows.exceptAll(again).isEmpty()
    got = np.array([r.v for r in rows.collect()])
    assert abs(got.mean() - 0.5) < 0.03 and (got >= 0).all() and (got <= 1).all()
    assert abs(got.var() * 4 * (2 * alpha + 1) - 1) < 0.08


def test_beta_of_large_alpha_is_refused():
    with pytest.raises(ValueError):
        beta(3.0, 1, "id")


def test_rows_nobody_picked_stay_where_they_are(spark):
    """Only keys are numbered; the payload meets few picks in a join that Spark broadcasts."""
    rows = spark.range(2000).select("id", (F.col("id") % 3).alias("g"), F.array_repeat(F.col("id").cast("double"), 50).alias("x"))
    drawn = sampling.sample_with_replacement(rows, "g", 5, 1, ["id"])
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = drawn.collect()
    assert len(got) == 15 and all(r.x == [float(r.id)] * 50 and r.id % 3 == r.g for r in got)
    assert drawn.columns == ["g", "draw", "id", "x"]


def test_skip_existing(spark, tmp_path):
    from trackweave.sources import files

    path = str(tmp_path / "out")
    rows = spark.range(10)
    rows.where("id < 4").write.parquet(path)
    files.append_missing(rows, path, ["id"])
    files.append_missing(rows, path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))
