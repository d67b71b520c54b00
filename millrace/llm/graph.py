"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "m").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is its least node.

    Each round is written to the shared folder. Rounds grow with the logarithm
    of the longest path. A hub's neighbours are never gathered: its least
    neighbour is partly aggregated, then joined, and the join may split.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m"))
    last = before = None
    while True:
        both = e.union(e.select("m", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), "m").distinct()
        nearest = large.groupBy("u").agg(F.min("m").alias("least"))
        small = large.join(nearest, "u").where("m != least").select(F.col("m").alias("u"), F.col("least").alias("m"))
        e = cut(small.union(nearest.toDF("u", "m")).distinct(), "stars")
        if before is not None:
            discard(before)
        before, now = e, _signature(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("m").alias("component")).union(e.select("m", "m").distinct())
