"""Connected components by alternating large-star and small-star steps; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta.llm.scratch import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the least node of its component."""
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    while True:
        now = _small_star(_large_star(now))
        now = materialise(now.distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen:
            break
        seen = state
    tree = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return tree.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
                            .join(tree.select("node"), "node", "left_anti"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")
