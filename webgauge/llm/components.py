"""Connected components by alternating star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.session import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or all smaller) neighbours of each node to the smallest node next to it.

    The smallest neighbour is a partial aggregate, and a node with very many neighbours meets its single
    row in a join that Spark splits.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    side = both.where("b > a") if larger else both.where("b < a")
    moved = side.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.unionByName(least.where("m < a").select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each round is stored in the shared folder; rounds grow with the logarithm of the longest path.
    Loops are ignored, and nodes without an edge are not listed. Null ends are dropped.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = materialize(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        after = materialize(_star(_star(now, larger=True), larger=False))
        ends = [d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (now, after)]
        now = after
        if ends[0] == ends[1]:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
