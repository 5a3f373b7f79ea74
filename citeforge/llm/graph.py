"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.scratch import apart, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(apart(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): each node of ``links`` (columns u, v) with the least node of its component.

    Rounds of a large and a small star, each written out, until the edges no longer change;
    they are then stars around the roots. The number of rounds grows with the logarithm of the
    largest component. Hot nodes are aggregated before the shuffle and joined by sort-merge,
    which AQE splits. Only a count and a checksum of the edges reach the driver.
    """
    oriented = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges, before = written(oriented, "edges"), None
    while True:
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))").alias("s")).first()
        if not seen["n"] or seen == before:
            break
        before = seen
        edges = written(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
