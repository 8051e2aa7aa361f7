"""Distributed union-find over an edge table by alternating large-star and small-star steps.

No step gathers a component or a node's neighbours in one place: a step is a minimum per node
(combined before its shuffle) and a join that adaptive execution may split. Edge tables of each
round are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filterlab.llm.common import forget, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is its component's least node.
    Null ends, self-edges and repeated edges are ignored."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(pairs.distinct(), "cc")
    while True:
        # done when every node that isn't a root has just one edge, and that to a root
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(now.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        loose = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 OR (ups = 1 AND n > 1)")
        if not loose.count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: the larger neighbours of a node move to its least neighbour
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = stored(both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v"), "cc")
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(moved.unionAll(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "cc")
        forget(large, before)
