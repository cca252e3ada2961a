"""Reachability and paths over edge tables, breadth first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loops import settle


def paths_from(edges: DataFrame, sources: DataFrame, most: int = 12) -> DataFrame:
    """source, node, path, depth: one shortest path (the least by its nodes) to everything within ``most`` hops; cycles end.

    ``edges``: a, b; ``sources``: source.
    """
    step = settle(edges.select(F.col("a").alias("e_a"), F.col("b").alias("e_b")).distinct())
    front = settle(sources.select("source", F.col("source").alias("node"), F.array("source").alias("path")))
    seen = front
    for _ in range(most):
        walked = front.join(step, F.col("node") == F.col("e_a")).select("source", F.col("e_b").alias("next"), F.concat("path", F.array("e_b")).alias("path"))
        best = walked.groupBy("source", "next").agg(F.min("path").alias("path")).select("source", F.col("next").alias("node"), "path")
        front = settle(best.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front))
    return seen.select("source", "node", "path", (F.size("path") - 1).alias("depth"))


def reachable(edges: DataFrame, pairs: DataFrame, most: int = 12) -> DataFrame:
    """source, target, reached for the pairs asked for."""
    hit = paths_from(edges, pairs.select("source").distinct(), most).select("source", F.col("node").alias("target"), F.lit(True).alias("hit"))
    return pairs.join(hit, ["source", "target"], "left").select("source", "target", F.coalesce("hit", F.lit(False)).alias("reached"))


def source_of(edges: DataFrame, leaves: DataFrame, wanted: DataFrame, most: int = 12) -> DataFrame:
    """fact_id, space, locator: for each (fact_id, space) wanted, the locator of the nearest source below it in that space.

    ``edges``: fact_id, support_id; ``leaves``: fact_id, space, locator.
    """
    below = paths_from(edges.toDF("a", "b"), wanted.select(F.col("fact_id").alias("source")).distinct(), most)
    rows = below.join(leaves.toDF("node", "space", "locator"), "node").filter("locator is not null")
    best = rows.groupBy(F.col("source").alias("fact_id"), "space").agg(F.min_by("locator", F.struct("depth", "path")).alias("locator"))
    return wanted.join(best, ["fact_id", "space"], "left")
