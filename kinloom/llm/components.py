"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours.

    The minima are written first: AQE splits a skewed join only where both its sides come straight from a shuffle.
    """
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = scratch.stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = scratch.stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; component is its smallest node.

    Every step's links are written to the shared folder, and the step's before deleted; the number of steps grows with the
    logarithm of the longest chain. Null ends and self-links are left out. No node's links are gathered in one task: sums are partial
    before the shuffle and hot nodes split in the join.
    """
    spark = links.sparkSession
    held = Scratch(spark, "links")
    edges = held.stored(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        large, small = Scratch(spark, "large-star"), Scratch(spark, "small-star")
        edges = small.stored(_small_star(large.stored(_large_star(edges, large), "step"), large), "step")
        large.clear()
        held.clear()
        held = small
        now = edges.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("sb"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    found = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct(), "components")
    held.clear()
    return found
