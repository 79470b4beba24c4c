"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for each end of the edges ``a, b``: the root is the smallest node reached.

    Nodes that no edge names are not returned; loops and repeated edges do no
    harm. Each step shrinks paths by about half; the driver sees only a row
    count and a checksum. Nodes are longs.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        # large star: each node's larger neighbours hang from its smallest neighbour
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
        edges = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        # small star: a node and its smaller neighbours hang from the smallest of them
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
