"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b long) to (node, root): root is the smallest node reachable.

    Each round is written to the shared folder; the rounds grow with the logarithm of the longest path. A hub is
    only ever joined with the one row of its smallest neighbour, and the minimum is taken before the shuffle.
    Self edges are ignored and nodes without another edge do not appear.
    """
    links = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        # Large star: every larger neighbour of a node moves to the smallest of its neighbourhood.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(small.union(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = now
