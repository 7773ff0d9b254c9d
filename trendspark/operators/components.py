"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select("category", F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("category", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, ["category", "a"]).filter(F.col("b") > F.col("a"))
    return linked.select("category", F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select("category", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("category", "a").agg(F.min("b").alias("m"))
    linked = down.join(least, ["category", "a"]).filter(F.col("b") != F.col("m"))
    moved = linked.select("category", F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("category", "a", "b")
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.pmod(mixed, F.lit(1_000_000_007)))
        ).first()
    )


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(category, node, component)``, named by the smallest node of the component.

    ``edges`` is ``(category, a, b)``; ``nodes`` ``(category, node)`` adds nodes without
    edges. Joins have one row per node on one side, so a hub's rows can be split.
    """
    edges = edges.select("category", "a", "b").filter(F.col("a") != F.col("b"))
    edges = materialize(_small_star(edges))
    seen = _fingerprint(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    members = edges.select("category", F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select("category", F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = members.unionByName(roots)
    if nodes is None:
        return found
    return nodes.select("category", "node").join(found, ["category", "node"], "left").select(
        "category", "node", F.coalesce("component", "node").alias("component")
    )
