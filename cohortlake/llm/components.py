"""Connected components of a link table, by rounds of Spark joins.

Each round links every node to the smallest node it knows of (large star,
then small star); the number of rounds grows with the logarithm of the
longest chain.  Every round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node u: larger neighbours (or all smaller ones and u itself) to the smallest of them and u."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.where("a > m").select("a", F.col("m").alias("b"))
    return linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: any order, no nulls) to rows (node, root): the smallest node of its component.

    Roots themselves have no row, nor have nodes without links.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        after = cut(_star(_star(edges, True).distinct(), False).distinct())
        # done when every node has one link and no root has a link of its own
        nodes = after.groupBy("a").agg(F.count("*").alias("n"))
        if after.join(nodes.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and nodes.where("n > 1").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after
