"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two aggregations and joins on equi-keys; a star of any size is handled by partial aggregation and by the
splitting of skewed joins. Every round ends in a checkpoint in the shared folder, and only a count reaches the driver; rounds
end once all edges are stars, which a count by node tells without a further round. The label of a component is its smallest
node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node (a) to a smaller one (b)."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether edges from a larger (a) to a smaller node (b) are stars: no node has two edges up, or one up and one down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count(F.when((F.col("up") > 0) & (F.col("up") + F.col("down") > 1), 1)).alias("n")).first()["n"] == 0


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable ids -> node, label for every node of an edge."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(edges):
        edges = checkpointed(small_star(large_star(edges)))
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
