"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stash

#: Pointer jumps within a round; longer chains take more rounds.
JUMPS = 3


def _ordered(edges: DataFrame) -> DataFrame:
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.select(lo, hi).filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a, b) with the least node it is connected to.

    In a round each node with a lesser neighbour moves to the least one, and
    edges between what they moved to remain; the number of nodes falls by a
    factor in every round, also on long paths, as moves are followed ``JUMPS`` times.
    Null ends and loops are left out; repeated edges count once.
    """
    rest = stash(_ordered(edges.select("a", "b")), "cc-edges")
    nodes = rest.select(F.col("a").alias("node")).union(rest.select(F.col("b"))).distinct().withColumn("root", F.col("node"))
    moves = []
    while not rest.isEmpty():
        move = rest.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p"))
        for _ in range(JUMPS if moves else 1):
            on = move.toDF("y", "q")
            move = move.join(on, F.col("p") == F.col("y"), "left").select("x", F.coalesce("q", "p").alias("p"))
        move = stash(move, "cc-move")
        moves.append(move)
        left = move.toDF("x1", "p1")
        right = move.toDF("x2", "p2")
        new = rest.join(left, F.col("a") == F.col("x1"), "left").select(F.coalesce("p1", "a").alias("a"), "b")
        new = new.join(right, F.col("b") == F.col("x2")).select("a", F.col("p2").alias("b"))
        old, rest = rest, stash(_ordered(new), "cc-edges")
        if len(moves) > 1:
            drop(old)
    for move in moves:
        step = move.toDF("x", "p")
        nodes = nodes.join(step, F.col("root") == F.col("x"), "left").select("node", F.coalesce("p", "root").alias("root"))
    return stash(nodes, "cc-roots")
