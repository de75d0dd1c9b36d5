"""Connected components by alternating stars, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b: long), where root is the smallest node that can be reached.

    Each round hangs every larger neighbour of a node under the smallest one, and then every smaller one; the number of
    edges never grows, and after O(log^2 n) rounds each component is a star around its smallest node. No node's
    neighbours are ever brought together: both steps are a minimum by key and a join. Loops and repeated edges are
    ignored; without edges the result is empty.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(ordered(edges))
    before = state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ordered(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(ordered(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))))
        after = state(edges)
        tidy(edges.sparkSession)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
