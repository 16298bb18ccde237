"""Pairs and triplets of windows and motifs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.functions.draws import digest, draw, draw_below, uniform
from trackweave.functions.vectors import mix
from trackweave.operators.numbering import group_offsets, number_shuffled, repeat_rows
from trackweave.operators.sampling import random_offset
from trackweave.session import cut_lineage


def window_neighbours(profile: DataFrame, width: int) -> DataFrame:
    """``(track, win, nbr)``: the most frequent neighbour window of each window.

    Profile positions are grouped in runs of ``width``; ties go to the smaller
    neighbour. Subsequences without a neighbour do not vote.
    """
    votes = profile.where("pi >= 0").groupBy(
        "track",
        F.expr(f"i div {width}").alias("win"),
        F.expr(f"pi div {width}").alias("nbr"),
    ).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("track", "win").agg(
        F.max(F.struct("votes", (-F.col("nbr")).alias("neg"))).alias("_b")
    )
    return best.select("track", "win", (-F.col("_b.neg")).alias("nbr"))


def neighbour_pairs(neighbours: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs both of whose windows exist, with the columns of both windows.

    ``windows`` has ``track, win_idx`` and any payload; columns come back with
    the prefixes ``anchor_`` and ``neighbor_``.
    """
    payload = [c for c in windows.columns if c != "track"]

    def side(prefix: str) -> DataFrame:
        return windows.select(
            "track",
            F.col("win_idx").alias(f"_{prefix}"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in payload],
        )

    return (
        neighbours.withColumnsRenamed({"win": "_anchor", "nbr": "_neighbor"})
        .join(side("anchor"), ["track", "_anchor"])
        .join(side("neighbor"), ["track", "_neighbor"])
        .drop("_anchor", "_neighbor")
    )


def batch_distants(
    batches: DataFrame, keys: Sequence[str], size: int, seed, payload: Sequence[str]
) -> DataFrame:
    """Give every pair a distant item out of another pair of its batch.

    ``batches`` has the batch ``keys``, a ``slot`` below ``size`` and, for each
    name in ``payload``, the columns ``anchor_<name>`` and ``neighbor_<name>``.
    The other slot is drawn from the remaining ones, never the own.
    """
    step = draw_below(F.lit(size - 1), seed, F.lit("slot"), *keys, "slot") + 1
    picked = batches.withColumn(
        "_other", F.pmod(F.col("slot") + step, F.lit(size)).cast("int")
    ).withColumn("_side", draw_below(F.lit(2), seed, F.lit("side"), *keys, "slot"))
    others = batches.select(
        *keys,
        F.col("slot").alias("_other"),
        *[F.col(f"{s}_{p}").alias(f"_{s}_{p}") for s in ("anchor", "neighbor") for p in payload],
    )
    got = picked.join(others, [*keys, "_other"])
    for p in payload:
        got = got.withColumn(
            f"distant_{p}",
            F.when(F.col("_side") == 0, F.col(f"_anchor_{p}")).otherwise(F.col(f"_neighbor_{p}")),
        )
    return got.select(*batches.columns, *[f"distant_{p}" for p in payload])


def numbered_members(df: DataFrame, group: str, seed, keys: Sequence[str]) -> DataFrame:
    """Number all rows so that each group is one contiguous range.

    Adds ``member`` (the number), and the group's ``n_group``, ``group_start``
    and the overall ``n_all`` and ``n_groups``. Rows without group go.
    """
    known = df.where(F.col(group).isNotNull())
    inside = number_shuffled(known, [group], seed, keys, "_in")
    return inside.join(group_offsets(known, group), group).withColumn(
        "member", F.col("group_start") + F.col("_in")
    ).drop("_in")


def outside_member(seed, *keys) -> Column:
    """A member number outside the own group's range, each equally likely."""
    at = F.pmod(draw(seed, *keys), F.col("n_all") - F.col("n_group"))
    return F.when(at >= F.col("group_start"), at + F.col("n_group")).otherwise(at)


def inside_member(seed, *keys) -> Column:
    """A member number of the own group."""
    return F.col("group_start") + F.pmod(draw(seed, *keys), F.col("n_group"))


def triplets(
    df: DataFrame,
    n_samples: int,
    seed,
    group: str = "family",
    window_sec: float = 7,
    key: str = "track",
) -> DataFrame:
    """``(index, a, a_loc, b, b_loc, c, c_loc)``: a shuffled triplet table.

    ``df`` has ``key, group, motif_0, motif_1, duration_seconds``. With
    ``k = n_samples // groups // 2`` every group gets ``k`` pairs of the two
    motif places of one track, completed by a motif of another group, and ``k``
    pairs across two tracks, completed by a random place in another group.
    Missing places are -1.

    All picks are numbers; one equi-join on the number fetches the tracks.
    """
    # read several times below; the motifs may be costly to find
    df = cut_lineage(df.select(key, group, "motif_0", "motif_1", "duration_seconds"))
    members = numbered_members(df, group, seed, [key])
    groups = group_offsets(df.where(F.col(group).isNotNull()), group)
    per_group = F.floor(F.floor(F.lit(n_samples) / F.col("n_groups")) / 2)
    slots = repeat_rows(groups, per_group).withColumn(
        "across", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    named = [group, "across", "draw"]
    first = inside_member(seed, F.lit("first"), *named)
    second = F.when(
        F.col("across") == 1, inside_member(seed, F.lit("second"), *named)
    ).otherwise(first)
    third = outside_member(seed, F.lit("third"), *named)
    picks = slots.where("n_all > n_group").select(
        *named,
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("role"), first.alias("member")),
                F.struct(F.lit("b").alias("role"), second.alias("member")),
                F.struct(F.lit("c").alias("role"), third.alias("member")),
            )
        ).alias("_p"),
    ).select(*named, "_p.role", "_p.member")
    tracks = members.select("member", key, "motif_0", "motif_1", "duration_seconds")
    place = (
        F.when(F.col("role") == "b", F.coalesce(F.col("motif_1"), F.lit(-1)).cast("double"))
        .when(
            (F.col("role") == "c") & (F.col("across") == 1),
            random_offset(
                F.coalesce(F.col("duration_seconds"), F.lit(-1.0)),
                window_sec,
                uniform(seed, F.lit("offset"), *named),
            ),
        )
        .otherwise(F.coalesce(F.col("motif_0"), F.lit(-1)).cast("double"))
    )
    found = picks.join(tracks, "member").select(*named, "role", key, place.alias("loc"))

    def of(role: str, column: str, name: str):
        return F.max(F.when(F.col("role") == role, F.col(column))).alias(name)

    rows = found.groupBy(*named).agg(
        *[x for r in "abc" for x in (of(r, key, r), of(r, "loc", f"{r}_loc"))]
    )
    return number_shuffled(rows, [], seed, named, "index").select(
        "index", group, "a", "a_loc", "b", "b_loc", "c", "c_loc"
    )


def mixed_up(batches: DataFrame, keys: Sequence[str], seed, weight, columns: Sequence[str]) -> DataFrame:
    """Blend every row with another row of its batch, element by element.

    Rows of a batch are put in random order and each is mixed with the next,
    the last with the first: ``x * weight + other * (1 - weight)`` for each array
    column. ``batches`` has the batch ``keys`` and ``slot``.
    """
    order = Window.partitionBy(*keys).orderBy(digest(seed, *keys, "slot"), "slot")
    everyone = Window.partitionBy(*keys)
    placed = batches.withColumn("_r", F.row_number().over(order) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(everyone)
    )
    partner = placed.select(
        *keys, F.col("_r").alias("_to"), *[F.col(c).alias(f"_{c}") for c in columns]
    )
    got = placed.withColumn("_to", F.pmod(F.col("_r") + 1, F.col("_n"))).withColumn("lam", weight)
    joined = got.join(partner, [*keys, "_to"])
    for c in columns:
        joined = joined.withColumn(c, mix(F.col(c), F.col(f"_{c}"), F.col("lam")))
    return joined.select(*batches.columns, "lam")
