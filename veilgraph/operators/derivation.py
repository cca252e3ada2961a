"""The derivation rules: facts from facts, with their supports.

A person spans spaces (level 1), two spaces share people (level 2), three spaces form a
cluster (level 3). Caps follow the order of the level-0 facts, so ``ord`` decides which supports are cited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .loops import settle

MOST_SPACES = MOST_SUPPORTS = 6


def person_support(facts0: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """*by, fact_id, entity, space, support_id, nth, ord: first fact per (entity, space), first six spaces, two at least."""
    first = facts0.groupBy(*by, "entity", "space").agg(F.min(F.struct("ord", "fact_id")).alias("f"))
    w = Window.partitionBy(*by, "entity")
    return (
        first.withColumn("nth", F.row_number().over(w.orderBy("f.ord")))
        .withColumn("n_spaces", F.count(F.lit(1)).over(w))
        .filter((F.col("n_spaces") >= 2) & (F.col("nth") <= MOST_SPACES))
        .select(*by, F.concat(F.lit("person:"), F.col("entity").cast("string")).alias("fact_id"), "entity", "space", F.col("f.fact_id").alias("support_id"), "nth", F.col("f.ord").alias("ord"))
    )


def spans(person: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """*by, a, b, person: each pair of spaces a < b that a person spans."""
    x = person.select(*by, "entity", F.col("space").alias("a"), F.col("fact_id").alias("person"))
    y = person.select(*by, "entity", F.col("space").alias("b"))
    return x.join(y, [*by, "entity"]).filter("a < b")


def pairs(person: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """*by, a, b, n_people: pairs of spaces that two people at least span."""
    return spans(person, by).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n_people")).filter("n_people >= 2")


def pair_support(person: DataFrame) -> DataFrame:
    """a, b, n_people, support_id: the first six people of each pair, by their first fact.

    The six least are kept per group of salted rows first, so a pair that many people span is not sorted in one task.
    """
    first = person.filter("nth = 1").select("entity", "ord")
    rows = spans(person).join(first, "entity")
    salted = rows.groupBy("a", "b", F.pmod(F.xxhash64("person"), F.lit(64)).alias("salt")).agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("ord", "person"))), 1, MOST_SUPPORTS).alias("least")
    )
    best = salted.groupBy("a", "b").agg(
        F.sum("n").alias("n_people"), F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, MOST_SUPPORTS).alias("least")
    )
    return best.filter("n_people >= 2").select("a", "b", "n_people", F.explode("least").alias("s")).select("a", "b", "n_people", F.col("s.person").alias("support_id"))


def clusters(pair: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """*by, a, b, c: triangles of pairs, a < b < c."""
    p = pair.select(*by, "a", "b")
    ab, bc, ac = p, p.toDF(*by, "b", "c"), p.toDF(*by, "a", "c")
    return ab.join(bc, [*by, "b"]).join(ac, [*by, "a", "c"]).select(*by, "a", "b", "c")


def pair_id(a: str, b: str):
    return F.concat(F.lit("pair:"), F.col(a), F.lit(":"), F.col(b))


def cluster_id():
    return F.concat(F.lit("cluster:"), F.concat_ws("|", "a", "b", "c"))


def derive(facts0: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The derived facts (fact_id, level, space, claim) and their edges (fact_id, support_id, kind)."""
    person = settle(person_support(facts0))
    pair = settle(pair_support(person))
    two = pair.select("a", "b").distinct()
    three = clusters(two)
    edges = person.select("fact_id", "support_id", F.lit("evidence").alias("kind")).unionByName(
        pair.select(pair_id("a", "b").alias("fact_id"), "support_id", F.lit("derivation").alias("kind"))
    )
    sides = F.explode(F.array(pair_id("a", "b"), pair_id("a", "c"), pair_id("b", "c")))
    edges = edges.unionByName(three.select(cluster_id().alias("fact_id"), sides.alias("support_id"), F.lit("derivation").alias("kind")))
    facts = (
        person.filter("nth = 1").select("fact_id", F.lit(1).alias("level"), "space", F.col("fact_id").alias("claim"))
        .unionByName(two.select(pair_id("a", "b").alias("fact_id"), F.lit(2).alias("level"), F.col("a").alias("space"), F.concat_ws("|", F.lit("pair"), "a", "b").alias("claim")))
        .unionByName(three.select(cluster_id().alias("fact_id"), F.lit(3).alias("level"), F.col("a").alias("space"), F.concat_ws("|", F.lit("cluster"), "a", "b", "c").alias("claim")))
    )
    return facts, edges
