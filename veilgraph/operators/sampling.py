"""Reproducible samples: seeded, spread over a ranking, and by overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seeded(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a digest of seed and key; the same on every run and engine."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def spread(ranked: DataFrame, order: list, n: int) -> DataFrame:
    """``n`` rows at equal steps of a ranking, first and last included (a report over principals, not over facts)."""
    total = ranked.count()
    if total <= n or n < 2:
        return ranked.orderBy(*order).limit(n)
    places = sorted({i * (total - 1) // (n - 1) for i in range(n)})
    return ranked.withColumn("vg_place", F.row_number().over(Window.orderBy(*order)) - 1).filter(F.col("vg_place").isin(places)).drop("vg_place")


def overlapping_spaces(member_of: DataFrame, n: int) -> list[str]:
    """``n`` spaces chosen greedily: the pair with the most members in common, then whatever shares most with those chosen."""
    x, y = member_of.toDF("principal", "a"), member_of.toDF("principal", "b")
    shared = x.join(y, "principal").filter("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    first = shared.filter("a < b").orderBy(F.desc("n"), "a", "b").limit(1).collect()
    chosen = [first[0]["a"], first[0]["b"]] if first else []
    while chosen and len(chosen) < n:
        best = shared.filter(F.col("a").isin(chosen) & ~F.col("b").isin(chosen)).groupBy("b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "b").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["b"])
    return chosen[:n]
