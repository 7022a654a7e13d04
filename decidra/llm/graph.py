"""Connected components by alternating large-star and small-star steps, each one join and one minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of edges(a, b); root is the smallest node that can be reached.

    Ends may be of any type with an order. Only the edge table moves between the steps; nothing is collected but
    its count and checksum. The minimum is stored before it is joined, so that a node with very many edges is a
    skewed join, which adaptive execution splits, and not a group in one task.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = _mark(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi")
        small = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo")))
        now = written(small.distinct(), "edges")
        before, seen = seen, _mark(now)
        if before == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
