"""What a run writes besides its tables: rows, a summary, where it came from, and the graph."""

from __future__ import annotations

import json
import platform
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.provenance import digest_tree


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in place of what was there."""
    rows.write.mode("overwrite").json(path)


def write_summary(spark, summary: dict, path: str) -> None:
    """One JSON object, with its keys sorted."""
    line = json.dumps(summary, sort_keys=True, ensure_ascii=False, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_provenance(sources: DataFrame, root: str, seed: int, repository: str = ".") -> dict:
    """Commit, whether the work tree was clean, time, versions, seed, and a digest of the corpus (source_id, text)."""
    git = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True, check=False)
    head, state = git("rev-parse", "HEAD"), git("status", "--porcelain")
    node = F.pmod(F.xxhash64("source_id"), F.lit(1 << 32)).alias("node")
    leaves = sources.select(node, F.sha2(F.concat_ws("\u0000", "source_id", F.coalesce("text", F.lit(""))), 256).alias("digest"))
    top = digest_tree(leaves, 4).filter("level = 4").select("digest").collect()
    size = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return {
        "commit": head.stdout.strip() if head.returncode == 0 else "unknown", "dirty": bool(state.stdout.strip()) if state.returncode == 0 else False,
        "generated_at": datetime.now(timezone.utc).isoformat(), "python": platform.python_version(), "spark": sources.sparkSession.version, "seed": seed,
        "corpus": {"root": root, "digest": top[0]["digest"] if top else None, "sources": size["n"], "bytes": size["b"]},
    }


def graph_edges(member_of: DataFrame, manages: DataFrame, sources: DataFrame, mentions: DataFrame, facts: DataFrame, rests_on: DataFrame, about: DataFrame) -> dict[str, DataFrame]:
    """The edge tables (a, b) of a graph, by kind.

    ``sources``: source_id, space; ``mentions``: source_id, nth, resolved; ``facts``: fact_id, space; ``rests_on``: fact_id, support_id; ``about``: fact_id, entity.
    """
    mention = F.concat_ws("#", "source_id", F.col("nth").cast("string"))
    two = lambda df, a, b: df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
    named = mentions.select("source_id", mention.alias("mention"), "resolved")
    return {
        "MEMBER_OF": two(member_of, "principal", "space"), "MANAGES": two(manages, "manager", "report"), "IN_SPACE": two(sources, "source_id", "space"), "FILED_UNDER": two(facts, "fact_id", "space"),
        "MENTIONS": two(named, "source_id", "mention"), "RESOLVES_TO": two(named.filter("resolved is not null"), "mention", "resolved"), "RESTS_ON": two(rests_on, "fact_id", "support_id"),
        "ABOUT": two(about, "fact_id", "entity"),
    }
