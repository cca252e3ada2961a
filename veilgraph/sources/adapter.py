"""Bring your own corpus, or your own system: what each must offer, and the score of a system on a corpus."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import permissions as P
from ..operators import provenance


class CorpusAdapter(Protocol):
    """A corpus under test. Permissions should be fetched rather than asserted, and must be complete."""

    name: str

    def sources(self) -> DataFrame:
        """fact_id, space: verbatim artifacts, each in one space."""

    def units(self) -> DataFrame:
        """unit_id, level, space (filed under, may be null), rests_on array<string> (units or sources)."""

    def permitted(self) -> DataFrame:
        """principal, space."""


class SystemUnderTest(Protocol):
    """A gate under test; retrieval and answers are its own business."""

    name: str

    def discloses(self, pairs: DataFrame) -> DataFrame:
        """Of (principal, perm, unit_id, level, space, rests_on) those rows that it would disclose."""


class Ungated:
    name = "ungated"

    def discloses(self, pairs: DataFrame) -> DataFrame:
        return pairs


class DocumentAcl:
    name = "document-acl"

    def discloses(self, pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.coalesce(F.array_contains("perm", F.col("space")), F.lit(False)))


class DerivationAware:
    """Needs the corpus, as it follows units to their sources itself."""

    name = "derivation-aware"

    def __init__(self, corpus: CorpusAdapter):
        self.required = truth(corpus)

    def discloses(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.required, "unit_id").filter(P.admissible(F.col("perm"), F.col("req"))).select(*pairs.columns)


def truth(corpus: CorpusAdapter) -> DataFrame:
    """unit_id, req: the spaces of every source that a unit transitively rests on, from the corpus and from nothing a system wrote."""
    edges = corpus.units().select(F.col("unit_id").alias("fact_id"), F.explode("rests_on").alias("support_id"))
    req = provenance.required_by_walk(edges, corpus.sources()).groupBy(F.col("fact_id").alias("unit_id")).agg(F.array_sort(F.collect_set("space")).alias("req"))
    # a unit without any support requires what nobody holds
    alone = F.array(F.lit(provenance.UNRESOLVABLE))
    return corpus.units().select("unit_id").distinct().join(req, "unit_id", "left").select("unit_id", F.coalesce("req", alone).alias("req"))


def score(corpus: CorpusAdapter, system: SystemUnderTest) -> DataFrame:
    """system, corpus, level, pairs, leaked, false_denials, flips, considered: one row per level of units."""
    perms = P.as_arrays(corpus.permitted())
    pairs = corpus.units().select("unit_id", "level", "space", "rests_on").crossJoin(perms)
    shown = system.discloses(pairs).select("principal", "unit_id", F.lit(True).alias("shown"))
    rows = pairs.join(truth(corpus), "unit_id").join(shown, ["principal", "unit_id"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    ok = P.admissible(F.col("perm"), F.col("req"))
    considered = ~ok & (F.size("req") > 1)
    n = lambda c, name: F.count_if(c).alias(name)
    out = rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("pairs"), n(F.col("shown") & ~ok, "leaked"), n(~F.col("shown") & ok, "false_denials"),
        n(considered & F.arrays_overlap("perm", "req"), "flips"), n(considered, "considered"),
    )
    return out.select(F.lit(system.name).alias("system"), F.lit(corpus.name).alias("corpus"), "*")
