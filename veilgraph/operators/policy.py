"""Policies as values: grants, compilation, and the effect of a change before it is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counting
from .loops import settle
from .permissions import as_arrays, permitted


def compile_policy(grants: DataFrame, manages: DataFrame | None) -> DataFrame:
    """principal, space from grants (subject, space); subjects outside the organisation keep their own."""
    return permitted(grants.select(F.col("subject").alias("principal"), "space"), manages)


def grant(grants: DataFrame, new: DataFrame) -> DataFrame:
    return grants.select("subject", "space").union(new.select("subject", "space")).distinct()


def revoke(grants: DataFrame, gone: DataFrame) -> DataFrame:
    return grants.join(gone.select("subject", "space"), ["subject", "space"], "left_anti")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """principal, old, new, gained, lost for every principal whose spaces change."""
    a, b = as_arrays(before).withColumnRenamed("perm", "old"), as_arrays(after).withColumnRenamed("perm", "new")
    none = F.array().cast("array<string>")
    both = a.join(b, "principal", "full").select("principal", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    return both.select("principal", "old", "new", F.array_except("new", "old").alias("gained"), F.array_except("old", "new").alias("lost")).filter(
        "size(gained) > 0 or size(lost) > 0"
    )


def preview(before: DataFrame, after: DataFrame, facts0: DataFrame, facts: DataFrame) -> DataFrame:
    """Per affected principal: spaces, documents and derived facts gained and lost, and what only the combination unlocks."""
    changed = changes(before, after)
    docs = facts0.groupBy("space").agg(F.count(F.lit(1)).alias("n"))

    def count(which: str, name: str) -> DataFrame:
        moved = changed.select("principal", F.explode(which).alias("space"))
        return moved.join(docs, "space").groupBy("principal").agg(F.sum("n").alias(name))

    # facts under old, new, what is in both, and what is new alone, each counted once
    sets = settle(changed.select("old", "new").distinct().withColumns({"kept": F.array_intersect("old", "new"), "fresh": F.array_except("new", "old")}))
    sides = ("old", "new", "kept", "fresh")
    each = settle(sets.select(F.explode(F.array(*[F.array_sort(c) for c in sides])).alias("names")).distinct().withColumn("sig", F.sha2(F.to_json("names"), 256)))
    req = settle(facts.filter("req is not null").groupBy(counting.wanted(F.col("req")).alias("want")).agg(F.count(F.lit(1)).alias("n")))
    under = settle(each.join(counting.covered(each, req, "sig"), "sig", "left").select("names", F.coalesce("n", F.lit(0)).alias("n")))
    for c in sides:
        sets = sets.join(under.select(F.col("names").alias("k"), F.col("n").alias(f"n_{c}")), F.array_sort(c) == F.col("k")).drop("k")
    free = req.agg(F.coalesce(F.sum(F.when(F.size("want") == 0, F.col("n"))), F.lit(0)).alias("free"))
    gained = F.col("n_new") - F.col("n_kept")
    derived = sets.crossJoin(free).select(
        "old", "new", gained.alias("derived_gained"), (F.col("n_old") - F.col("n_kept")).alias("derived_lost"), (gained - (F.col("n_fresh") - F.col("free"))).alias("by_combination")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        changed.join(derived, ["old", "new"]).join(count("gained", "documents_gained"), "principal", "left").join(count("lost", "documents_lost"), "principal", "left")
        .select("principal", F.size("gained").cast("long").alias("spaces_gained"), F.size("lost").cast("long").alias("spaces_lost"), zero("documents_gained"), zero("documents_lost"),
                "derived_gained", "derived_lost", "by_combination")
    )


def simulate_grants(perms: DataFrame, grants: DataFrame, facts0: DataFrame, facts: DataFrame) -> DataFrame:
    """principal, space, documents, derived, by_combination for each single grant (principal, space) tried alone."""
    rows = grants.join(perms, "principal", "left").withColumn("old", F.coalesce("perm", F.array().cast("array<string>"))).drop("perm").withColumn("sig", F.sha2(F.to_json("old"), 256))
    docs = facts0.groupBy("space").agg(F.count(F.lit(1)).alias("n_docs"))
    req = facts.filter("req is not null").groupBy(counting.wanted(F.col("req")).alias("want")).agg(F.count(F.lit(1)).alias("n"))
    # a grant unlocks what lacks its space alone, and only in combination what asks for more than it
    gain = counting.one_short(settle(rows.select("sig", F.col("old").alias("names")).distinct()), req, "sig").select("sig", F.col("name").alias("space"), F.col("n").alias("derived"), F.col("n_more").alias("by_combination"))
    held = F.array_contains("old", F.col("space"))
    return rows.join(gain, ["sig", "space"], "left").join(docs, "space", "left").select(
        "principal", "space", F.when(held, F.lit(0)).otherwise(F.coalesce("n_docs", F.lit(0))).alias("documents"), F.coalesce("derived", F.lit(0)).alias("derived"), F.coalesce("by_combination", F.lit(0)).alias("by_combination")
    )


def from_model(member_of: DataFrame) -> DataFrame:
    """subject, space: the grants that a model of memberships stands for."""
    return member_of.select(F.col("principal").alias("subject"), "space").distinct()


def most_affected(impacts: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` impacts by derived facts gained, then documents gained, then principal."""
    return impacts.orderBy(F.desc("derived_gained"), F.desc("documents_gained"), "principal").limit(most)


def impact_totals(impacts: DataFrame) -> DataFrame:
    """One row: principals affected, what all of them gain and lose, and derived facts gained per document gained."""
    names = ("documents_gained", "documents_lost", "derived_gained", "derived_lost", "by_combination")
    total = impacts.agg(F.count(F.lit(1)).alias("principals"), *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
    return total.select("*", F.round(F.coalesce(F.try_divide("derived_gained", "documents_gained"), F.lit(0.0)), 6).alias("hidden_ratio"))


def grant_summary(simulated: DataFrame) -> DataFrame:
    """One row over simulated grants (documents, derived, by_combination): totals, how many unlock anything, mean and median yield."""
    n = lambda c, name: F.count_if(c).alias(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    ratio = F.when(F.col("documents") > 0, F.col("derived") / F.col("documents"))
    out = simulated.agg(
        F.count(F.lit(1)).alias("simulated"), total("documents"), total("derived"), total("by_combination"), n(F.col("derived") > 0, "with_derived"), n(F.col("by_combination") > 0, "with_combination"),
        F.round(F.median(ratio), 4).alias("median_per_document"),
    )
    return out.select("*", F.round(F.col("derived") / F.greatest("with_derived", F.lit(1)), 2).alias("mean_per_unlocking"))


def widest(simulated: DataFrame, most: int = 5) -> DataFrame:
    """The grant that unlocks most of each space (ties: the least principal), the ``most`` widest spaces first."""
    key = F.struct((-F.col("derived")).alias("d"), "principal")
    best = simulated.groupBy("space").agg(F.min(F.struct(key.alias("key"), "principal", "documents", "derived", "by_combination")).alias("x")).select("space", "x.principal", "x.documents", "x.derived", "x.by_combination")
    return best.orderBy(F.desc("derived"), "space").limit(most)
