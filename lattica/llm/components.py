"""Connected components of a graph held in tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stage, unstage


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung to the node's least neighbour."""
    both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y"))


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung to the least of them."""
    least = e.groupBy("x").agg(F.min("y").alias("m"))
    hung = e.join(least, "x").where(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y"))
    return hung.unionByName(least.select("x", F.col("m").alias("y")))


def _stars(e: DataFrame) -> bool:
    """Has every node one edge down, and no node edges both up and down."""
    up = e.groupBy("x").agg(F.count("*").alias("k"))
    if not up.where("k > 1").isEmpty():
        return False
    return e.join(up.select(F.col("x").alias("y")), "y", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another: the root is the least node of its component.

    ``edges``: columns x, y of one integer type, in any order, with repeats or loops. The rounds are logarithmic in
    the longest path; each half of one is written to the shared folder, so that no plan grows with a round, and only
    whether it is done comes to the driver.
    """
    e = edges.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    e = stage(e.distinct(), "edges")
    while not _stars(e):
        last, e = e, stage(_large(e).distinct(), "edges")
        unstage(last)
        last, e = e, stage(_small(e).distinct(), "edges")
        unstage(last)
    return e.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
