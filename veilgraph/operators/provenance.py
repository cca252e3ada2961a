"""What a fact requires: the spaces of every source it rests on, by two formulations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loops import settle, transitive

#: Stands in a requirement for what could not be resolved; no principal holds it.
UNRESOLVABLE = "__unresolvable__"


def required_by_walk(edges: DataFrame, facts0: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """fact_id, space by a fixpoint over the supports; supports that lead nowhere, or past ``most_rounds``, require the sentinel."""
    reach, frontier = transitive(edges.select("fact_id", "support_id").distinct(), most_rounds)
    home = facts0.select(F.col("fact_id").alias("support_id"), "space").distinct()
    inner = edges.select(F.col("fact_id").alias("support_id")).distinct()
    found = reach.join(home, "support_id").select("fact_id", "space")
    lost = reach.join(home, "support_id", "left_anti").join(inner, "support_id", "left_anti").select("fact_id")
    cut = frontier.join(inner, "support_id", "left_semi").select("fact_id") if most_rounds else frontier.select("fact_id").limit(0)
    return found.union(lost.union(cut).select("fact_id", F.lit(UNRESOLVABLE).alias("space"))).distinct()


def required_by_levels(facts: DataFrame, edges: DataFrame, facts0: DataFrame, deepest: int = 3) -> DataFrame:
    """fact_id, space level by level: a fact requires the union of what its supports require."""
    known = facts0.select("fact_id", "space").distinct()
    every = None
    for level in range(1, deepest + 1):
        here = facts.filter(F.col("level") == level).select("fact_id")
        new = edges.join(here, "fact_id", "left_semi").select("fact_id", "support_id").join(known.toDF("support_id", "space"), "support_id").select("fact_id", "space").distinct()
        every = new if every is None else every.unionByName(new)
        known = new
    return every


def with_requirement(facts: DataFrame, required: DataFrame) -> DataFrame:
    """``facts`` with req, the sorted array of required spaces; null where nothing is known."""
    return facts.join(required.groupBy("fact_id").agg(F.array_sort(F.collect_set("space")).alias("req")), "fact_id", "left")


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """same, n: how many facts two formulations agree on; mutual absence is no agreement."""
    a = one.groupBy("fact_id").agg(F.array_sort(F.collect_set("space")).alias("x"))
    b = two.groupBy("fact_id").agg(F.array_sort(F.collect_set("space")).alias("y"))
    same = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    return a.join(b, "fact_id", "full").groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n"))


def required_by_stack(edges: DataFrame, facts0: DataFrame, facts: DataFrame) -> DataFrame:
    """fact_id, space by a third formulation: sets of spaces are handed up along the supports until none grows.

    What is kept is (fact, space) alone, never a pair of a fact and something below it.
    """
    known = settle(facts0.select("fact_id", "space").distinct())
    new, out = known, None
    while not new.isEmpty():
        up = edges.select("fact_id", "support_id").join(new.toDF("support_id", "space"), "support_id").select("fact_id", "space").distinct()
        new = settle(up if out is None else up.join(out, ["fact_id", "space"], "left_anti"))
        out = new if out is None else settle(out.unionByName(new))
    return out.join(facts.select("fact_id").distinct(), "fact_id", "left_semi")


def citations_under(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """fact_id, citation: the citations of every source (source_id, citation) that a fact rests on, at any depth."""
    reach, _ = transitive(edges.select("fact_id", "support_id").distinct())
    return reach.join(sources.select(F.col("source_id").alias("support_id"), "citation"), "support_id").select("fact_id", "citation").distinct()


def digest_tree(leaves: DataFrame, levels: int, width: int = 256) -> DataFrame:
    """level, node, digest from leaves (node, digest): a node digests those of ``width`` numbers below it, in order."""
    out, below = None, leaves.select("node", "digest")
    for level in range(1, levels + 1):
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), ",")
        below = settle(below.groupBy(F.floor(F.col("node") / width).cast("long").alias("up")).agg(F.sha2(parts, 256).alias("digest")).select(F.col("up").alias("node"), "digest"))
        here = below.select(F.lit(level).alias("level"), "node", "digest")
        out = here if out is None else out.unionByName(here)
    return out


def chains(edges: DataFrame, depth: int = 4, supports: int = 6) -> DataFrame:
    """fact_id, chain: the supports nested to ``depth`` levels, the first ``supports`` of each fact, as JSON.

    Of every fact only the least ids of its supports are kept before anything is nested, by parts first.
    """
    salt = F.pmod(F.xxhash64("support_id"), F.lit(64)).alias("salt")
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, supports).alias("s")
    parts = edges.select("fact_id", "support_id").distinct().groupBy("fact_id", salt).agg(least(F.collect_list("support_id")))
    few = settle(parts.groupBy("fact_id").agg(least(F.flatten(F.collect_list("s")))).select("fact_id", F.explode("s").alias("support_id")))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    chain = few.select(F.col("support_id").alias("s_id")).distinct().withColumn("below", F.concat(F.lit('{"id":'), quoted(F.col("s_id")), F.lit("}")))
    nested = lambda: F.transform(F.array_sort(F.collect_list(F.struct("support_id", "below"))), lambda x: x["below"])
    for _ in range(depth - 1):
        below = few.join(chain, F.col("support_id") == F.col("s_id")).groupBy("fact_id").agg(nested().alias("parts"))
        node = F.concat(F.lit('{"id":'), quoted(F.col("fact_id")), F.lit(',"supports":['), F.array_join("parts", ","), F.lit("]}"))
        deeper = below.select(F.col("fact_id").alias("d_id"), node.alias("deep"))
        chain = settle(chain.join(deeper, F.col("s_id") == F.col("d_id"), "left").select("s_id", F.coalesce("deep", "below").alias("below")))
    return few.join(chain, F.col("support_id") == F.col("s_id")).groupBy("fact_id").agg(nested().alias("chain"))
