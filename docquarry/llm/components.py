"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import staged, unstaged


def settled(edges: DataFrame) -> bool:
    """Whether each node of the distinct ``edges`` has one ``b`` at most, and none if it is one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("ties")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("ties")))
    odd = ends.groupBy("node").agg(F.sum("ties").alias("ties"), F.min("ties").alias("least")).where("ties > 1 OR ties = 1 AND least = 0")
    return not odd.limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge (columns a, b); root is the least node of its component.

    Each round is two joins on keyed aggregates and is written to the shared folder in place of the one before; nothing
    but counts reaches the driver. It stops when every node is a root or tied to one root only, which no round would change.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not settled(now):  # the stars settle after a number of rounds that is a power of the logarithm of the nodes
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # every larger neighbour is tied to the least of the neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # every smaller neighbour, and the node itself
        small = large.join(least, "a")
        tied = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now, before = staged(tied.where("a <> b").distinct(), "edges"), now
        unstaged(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
