"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import release, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link. `edges` has columns a, b.

    Each round joins every link with the least neighbour of its end, so long chains shorten by half and a hub's links
    are never gathered: minima are combined before the shuffle, and the joins' heavy keys can be split at run time.
    Rounds are written to the shared folder; nothing of them reaches the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e = staged(e, "links")
    while True:
        # done when every link leads to a node that leads nowhere, and every node has one link
        ends = e.select("a").union(e.select("b").distinct()).groupBy("a").count()
        if ends.where("count > 1").isEmpty():
            stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # as many rows as links; the second star's distinct is enough to keep them few
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = staged(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, staged(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        release(last, large)
