"""Connected components of links between any ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import stored


def _print_of(edges: DataFrame) -> tuple:
    """Count and an order-free hash of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest reachable id) for every node of a link.

    Each round keeps the components, and has at most as many edges as links: the minimum of a node's neighbours combines
    map-side, and only (node, minimum) pairs are joined, so a node with very many links is no group in one task.
    Rounds end when the edges no longer change; their number grows with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high <> low").distinct()
    edges = stored(edges, "component-edges")
    seen = _print_of(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("m")).withColumn("m", F.least("m", "high"))
        large = both.filter(F.col("low") > F.col("high")).join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low")).distinct()
        large = stored(large, "component-large")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").filter(F.col("low") > F.col("m")).select(F.col("low").alias("high"), F.col("m").alias("low"))
        edges = stored(small.unionByName(least.withColumnRenamed("m", "low")).distinct(), "component-edges")
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)
