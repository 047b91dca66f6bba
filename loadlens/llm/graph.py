"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is a partial aggregate and a join on node ids, whose hot nodes the skew join splits; the edge list never
grows beyond its first size. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.tables import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger id to the smaller; every neighbour below moves to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; ``edges`` has long columns a and b.

    Ends when a round leaves the edges as they were (each then runs from a node to its root).
    """
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
        edges = materialise(_small_star(_large_star(edges)), "edges")
