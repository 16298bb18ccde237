"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in a fixed shuffled order. The *virtual finish
time* of its e-th copy is the number of words its source has served when the copy ends,
divided by the weight of the source. Copies of all sources are put in the order of their
finish times and taken until the budget is spent. A source whose copies are used up
leaves the rest of the budget to the others, which is what a fair queue does.

No order is ever made in one task: a source is cut in ranges of the shuffled order and
the clock in ranges of finish time. Only sums per range are accumulated as a whole, and
only the single range in which the budget ends is ordered row by row.

Defined cases: null text and text without words have size 0 and take nothing; a null
source is a source of its own, after all others; rows that agree in id, source and size
share one place and are taken alike; an empty table gives an empty result; a null id is
an id of its own. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.functions.draws import HEX_DIGITS, draw
from trackweave.llm.names import fresh
from trackweave.session import cut_lineage

ROWS = 50_000  # rows of one range of an order
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("bigint")


@dataclass
class Clock:
    """Documents on the virtual clock and the point at which the budget ends."""

    rows: DataFrame  # doc_id, source, size, draw, source_rank, weight, source_size, target, cum
    repeats: int
    ranges: float  # ranges per unit of virtual time
    last: int  # the range in which the budget ends; all copies before it are taken
    cut: tuple[float, int, int] | None  # the last copy taken in that range

    def finish(self, e: int | Column) -> Column:
        return (F.lit(e) * F.col("source_size") + F.col("cum")) / F.col("weight")

    def range_of(self, e: int | Column) -> Column:
        return F.least(F.floor(self.finish(e) * self.ranges), F.lit(1 << 40)).cast("bigint")

    def copies(self) -> Column:
        """How many copies of a document the mix takes."""
        taken = []
        for e in range(self.repeats):
            inside = F.lit(False)
            if self.cut is not None:
                inside = F.struct(self.finish(e).alias("a"), F.col("source_rank").alias("b"), F.lit(e).alias("c")) <= F.struct(
                    F.lit(float(self.cut[0])).alias("a"), F.lit(self.cut[1]).alias("b"), F.lit(self.cut[2]).alias("c")
                )
            at = self.range_of(e)
            taken.append(((at < self.last) | ((at == self.last) & inside)).cast("int"))
        return sum(taken[1:], taken[0])


def _source_plan(sums: DataFrame, weights: Sequence[float], repeats: int, share: float) -> DataFrame:
    """Weight, size and target of each source. One row per source, so windows over all are small."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sums.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    )
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy("_limit", "source_rank")
    level = F.when(F.col("_level") <= F.col("_limit"), F.struct("_limit", "source_rank", "_level"))
    return (
        ranked.withColumn("weight", given)
        .withColumn("_most", F.lit(repeats) * F.col("source_size"))
        .withColumn("_limit", F.col("_most") / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_used", F.coalesce(F.sum("_most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_used")) / F.col("_open"))
        .withColumn("level", F.coalesce(F.min(level).over(every)["_level"], F.max("_limit").over(every)))
        .withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("_most").cast("double")))
        .select("source", "source_rank", "weight", "source_size", "target", "level", F.col("_budget").alias("budget"))
    )


def clock(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    repeats: int = 3,
    share: float = 1.0,
    seed: str = "mix",
    text: str = "text",
) -> Clock:
    """Place all documents on the virtual clock of their sources.

    Sources take ``weights`` in turn, in code point order with null last. The budget is
    ``share`` of all words; no document is taken more than ``repeats`` times.
    """
    rows = cut_lineage(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            word_count(F.col(text)).alias("size"),
            draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"),
        )
    )
    n = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / ROWS)))
    rows = rows.withColumn("_key", F.struct("source", F.shiftright("draw", 4 * HEX_DIGITS - bits).alias("part")))
    sums = cut_lineage(
        rows.groupBy("_key").agg(F.sum("size").alias("size")).select("_key.source", "_key.part", "size")
    )
    plan = _source_plan(sums, weights, repeats, share)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    offsets = (
        offsets.alias("o")
        .join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")))
        .select(F.struct("o.source", "o.part").alias("_key"), "_before", "source_rank", "weight", "source_size", "target", "level", "budget")
    )
    peers = Window.partitionBy("_key").orderBy("draw", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut_lineage(
        rows.withColumn("_inside", F.sum("size").over(peers))
        .join(offsets, "_key")
        .withColumn("cum", F.col("_before") + F.col("_inside"))
        .drop("_key", "_before", "_inside")
    )
    whole = placed.agg(F.max("level").alias("level"), F.max("budget").alias("budget")).first()
    if not whole["level"]:
        return Clock(placed, repeats, 1.0, 0, None)
    ranges = max(16, math.ceil(n * repeats / ROWS)) / whole["level"]
    made = Clock(placed, repeats, ranges, 0, None)
    copies = placed.where("size > 0").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("_finish", made.finish(F.col("e"))).withColumn("_range", made.range_of(F.col("e")))
    filled = copies.groupBy("_range").agg(F.sum("size").alias("size"))
    by_time = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    end = (
        filled.withColumn("_before", F.coalesce(F.sum("size").over(by_time), F.lit(0)))
        .where(F.col("_before") + F.col("size") > F.lit(whole["budget"]))
        .agg(F.min(F.struct("_range", "_before")).alias("end"))
        .first()["end"]
    )
    if end is None:  # everything fits
        return Clock(placed, repeats, ranges, 1 << 41, None)
    in_order = Window.orderBy("_finish", "source_rank", "e").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        copies.where(F.col("_range") == end["_range"])
        .withColumn("_sum", F.lit(end["_before"]) + F.sum("size").over(in_order))
        .where(F.col("_sum") <= F.lit(whole["budget"]))
        .agg(F.max(F.struct("_finish", "source_rank", "e")).alias("cut"))
        .first()["cut"]
    )
    return Clock(placed, repeats, ranges, end["_range"], None if cut is None else tuple(cut))


def taken(made: Clock) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: words taken of every document."""
    words = (F.col("size") * made.copies()).cast("bigint")
    return made.rows.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def mixed(docs: DataFrame, made: Clock, seed: str = "mix", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Along the shuffled order of a source the number of copies never rises, so one place
    per source tells the copies of each row and the texts need no shuffle.
    """
    counted = made.rows.withColumn("_copies", made.copies())
    least = counted.groupBy("source").agg(F.min(F.when(F.col("size") > 0, F.col("_copies"))).alias("_least"))
    place = F.struct("draw", "doc_id", "size")
    both = counted.alias("c").join(least.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")))
    # further columns of any name stay as they are
    own, low, cut, here, copy = fresh(docs.columns, "_source", "_least", "_cut", "_here", "_copy")
    per_source = both.groupBy(F.col("c.source").alias(own)).agg(
        F.first("_least").alias(low),
        F.max(F.when((F.col("size") > 0) & (F.col("_copies") > F.col("_least")), place)).alias(cut),
    )
    at = F.struct(
        draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"),
        F.col("doc_id"),
        word_count(F.col(text)).alias("size"),
    )
    rows = docs.withColumn(here, at)
    copies = F.col(low) + F.coalesce(F.col(here) <= F.col(cut), F.lit(False)).cast("int")
    return (
        rows.join(cut_lineage(per_source), rows["source"].eqNullSafe(F.col(own)))
        .where(F.col(here)["size"] > 0)
        .withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
