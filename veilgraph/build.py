"""From a corpus to facts: mentions, resolution, facts from texts, derivation, requirements. Also a command."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import best_sentences
from .operators import derivation, mentions, permissions, provenance, sampling
from .operators.loops import settle
from .sources import corpus as C
from .sources import sinks


@dataclass
class Built:
    """mentions, resolved, facts (fact_id, level, space, text, claim, req), rests_on, about, permitted of a corpus."""

    corpus: C.Corpus
    mentions: DataFrame
    resolved: DataFrame
    facts: DataFrame
    rests_on: DataFrame
    about: DataFrame
    permitted: DataFrame

    def stats(self) -> dict:
        """Counts of mentions, resolutions, their accuracy, and facts by level."""
        found = self.corpus
        by_method = {r["method"]: r["n"] for r in self.resolved.groupBy("method").agg(F.count(F.lit(1)).alias("n")).collect()}
        accuracy = mentions.accuracy_summary(mentions.resolution_accuracy(self.mentions, self.resolved, found.sources)).first().asDict()
        levels = {r["level"]: r["n"] for r in self.facts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
        widest = self.facts.agg(F.max(F.size("req"))).first()[0]
        return {"sources": found.sources.count(), "mentions": self.mentions.count(), "resolved": self.resolved.filter("resolved is not null").count(), "by_method": by_method, "accuracy": accuracy, "facts": levels, "widest": widest}

    def edges(self) -> dict[str, DataFrame]:
        return sinks.graph_edges(self.corpus.member_of, self.corpus.manages, self.corpus.sources, self.resolved, self.facts, self.rests_on, self.about)


def observed(sources: DataFrame, entities: DataFrame) -> DataFrame:
    """fact_id, source_id, space, text, ord: the two most informative sentences of every source, with the people resolved in it counted in.

    ``entities``: source_id, entity.
    """
    n = entities.groupBy("source_id").agg(F.count_distinct("entity").alias("n_entities"))
    rows = sources.join(n, "source_id", "left").select("source_id", "space", F.posexplode(best_sentences(F.col("text"), F.coalesce("n_entities", F.lit(0)).cast("double"))).alias("i", "b"))
    fact = F.concat(F.lit("f:"), "source_id", F.lit("#"), F.col("i").cast("string"))
    return rows.select(fact.alias("fact_id"), "source_id", "space", F.col("b.sentence").alias("text"), F.struct("source_id", "i").alias("ord"))


def build(corpus: C.Corpus, most_spaces: int | None = None) -> Built:
    """Every stage over the whole corpus, or over ``most_spaces`` spaces that overlap most."""
    if most_spaces is not None:
        spaces = F.col("space").isin(sampling.overlapping_spaces(corpus.member_of, most_spaces))
        corpus = C.Corpus(corpus.sources.filter(spaces), corpus.member_of.filter(spaces), corpus.manages, corpus.employees, None if corpus.questions is None else corpus.questions.filter(spaces))
    found = settle(mentions.extract(corpus.sources, corpus.employees))
    roster = corpus.member_of.select("space", F.col("principal").alias("employee_id"))
    resolved = settle(mentions.resolve(found, corpus.sources, corpus.employees, roster))
    entities = resolved.filter("resolved is not null").select("source_id", F.col("resolved").alias("entity")).distinct()
    zero = settle(observed(corpus.sources, entities))
    facts0 = zero.join(entities, "source_id").select("fact_id", "entity", "space", "ord")
    derived, edges = derivation.derive(facts0)
    derived, edges = settle(derived), settle(edges)
    required = provenance.required_by_levels(derived, edges, facts0)
    levels = provenance.with_requirement(derived, required)
    text = F.when(F.col("level") == 1, F.concat(F.substring("fact_id", 8, 1 << 20), F.lit(" works across "), F.array_join("req", ", "))).otherwise(
        F.concat(F.array_join("req", ", "), F.lit(" share people"))
    )
    facts = zero.select("fact_id", F.lit(0).alias("level"), "space", "text", F.lit(None).cast("string").alias("claim"), F.array("space").alias("req"))
    facts = facts.unionByName(levels.select("fact_id", "level", "space", text.alias("text"), "claim", "req"))
    rests_on = edges.select("fact_id", "support_id").unionByName(zero.select("fact_id", F.concat(F.lit("s:"), "source_id").alias("support_id")))
    about = facts0.select("fact_id", "entity").unionByName(derivation.person_support(facts0).filter("nth = 1").select("fact_id", "entity"))
    return Built(corpus, found, resolved, settle(facts), rests_on, about, settle(permissions.permitted(corpus.member_of, corpus.manages)))


def main(argv: list[str] | None = None) -> None:
    """``python -m veilgraph.build ROOT OUT [--snapshot] [--spaces N] [--dry]``"""
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--snapshot", action="store_true", help="ROOT is a snapshot of repositories")
    p.add_argument("--spaces", type=int, help="only so many spaces, those that overlap most")
    p.add_argument("--dry", action="store_true", help="count, but write no graph")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("veilgraph-build").getOrCreate()
    built = build(C.load_snapshot(spark, args.root) if args.snapshot else C.load(spark, args.root), args.spaces)
    summary = built.stats() | {"provenance": sinks.run_provenance(built.corpus.sources, args.root, 0)}
    if not args.dry:
        C.write_graph(built.edges(), f"{args.out}/graph")
        built.facts.write.mode("overwrite").parquet(f"{args.out}/facts")
        built.permitted.write.mode("overwrite").parquet(f"{args.out}/permitted")
    sinks.write_summary(spark, summary, f"{args.out}/summary")
    print(summary)


if __name__ == "__main__":
    main()
