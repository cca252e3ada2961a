"""Fixpoints over DataFrames, with lineage cut by checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and everything runs on one machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="veilgraph-"))
    return df.checkpoint()


def transitive(edges: DataFrame, most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The transitive closure of ``edges`` (two columns), semi-naive and safe on cycles, and the frontier left.

    The frontier is empty unless ``most_rounds`` ended the walk, so a caller can fail closed.
    """
    head, tail = edges.columns
    step = settle(edges.distinct())
    next_ = step.toDF("vg_from", "vg_to")
    seen = frontier = step
    rounds = 1
    while not frontier.isEmpty() and (most_rounds is None or rounds < most_rounds):
        walked = frontier.toDF("vg_start", "vg_mid").join(next_, on=[_eq("vg_mid", "vg_from")]).select("vg_start", "vg_to").distinct().toDF(head, tail)
        frontier = settle(walked.join(seen, [head, tail], "left_anti"))
        seen = settle(seen.unionByName(frontier))
        rounds += 1
    return seen, frontier


def _eq(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)
