"""Connected components as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find by alternating large-star and small-star rounds.

    edges: columns a, b of any orderable type, null-free; direction, repeats and
    self-loops don't matter. Result: (node, root) for every node that has an edge
    to another node; root is the component's smallest node. Every round is
    materialised in the checkpoint folder, so a lost executor costs one round.
    """
    e = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _settled(e):
            break
        e = cut(_small_star(_large_star(e)))
    else:
        if not _settled(e):
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _settled(e: DataFrame) -> bool:
    """Whether every node is linked to one smaller node at most, or only to larger ones: then it is told without another round
    that each of them is the smallest of its component."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    e = e.distinct()
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()
