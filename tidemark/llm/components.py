"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b), root being the smallest node reachable.

    Alternating large-star and small-star steps: each keeps connectivity, and the number of rounds
    grows with the logarithm of the longest chain. Every round is written to the shared folder.
    An aggregate with map-side combine finds each node's smallest neighbour, and the join with
    it is an ordinary sort-merge join, so a node with very many links is split at run time.
    """
    edges = spill(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        after = spill(small, "links")
        # a star forest: nobody has two targets, and no target has one of its own
        more = after.groupBy("a").count().where("count > 1").limit(1).unionByName(after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi").select("a", F.lit(2).cast("long").alias("count")).limit(1))
        edges = after
        if more.isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
