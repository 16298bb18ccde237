"""Connected components of a table of links.

Large-star and small-star steps in turn: every node is tied to the smallest node among
its neighbours until all links point to the smallest node of their component. Each step
is written to the shared folder, so no lineage grows and a lost executor repeats one
step only. Links never reach the driver, only the number of those that are not settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackweave.session import cut_lineage


def _large(links: DataFrame) -> DataFrame:
    """Ties the larger neighbours of each node to the smallest; links ``(a, b)`` with ``a > b``, repeats allowed."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the smallest of them, each link once."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return links.join(least, "a").select(ends.alias("_l")).select("_l.a", "_l.b").where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether all links point straight to the smallest node: no target has a link of its own, no node two."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    loose = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 AND out > 0")
    return loose.agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes with a link that are not the smallest of their component.

    ``links`` has two columns of whole numbers, in any order; links to oneself count as none.
    It is read several times, so it should come from a written table.
    """
    x, y = links.columns[:2]
    edges = links.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    while True:
        edges = cut_lineage(_small(cut_lineage(_large(edges))))
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
