"""Connected components of an edge table by alternating stars; nothing is fetched but a count per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (a, b); component is the smallest node reachable.

    Each round hangs every neighbour on the smallest one: first the larger neighbours, then the smaller ones. Rounds
    grow with the logarithm of the longest path. Neighbourhood minima are aggregated before the shuffle, so that a hub
    is no hot group.
    """
    now = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        then = staged(small.filter("u != v").distinct(), "edges")
        # stars only: no edge starts where another ends
        if then.join(then.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            if then.groupBy("u").count().filter("count > 1").limit(1).count() == 0:
                discard(now)
                return then.select(F.col("u").alias("node"), F.col("v").alias("component"))
        discard(now)
        now = then
