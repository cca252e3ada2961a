"""Claims read from texts: which spaces a text names, and which of its people it places there."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .permissions import audiences

#: Up to so many names are searched by one automaton in every task (some tens of MB); more by a join on containment.
MOST_NAMES = 200_000


def space_names(spaces: DataFrame) -> DataFrame:
    """name, space from (space, label): the lower-cased id and, where it differs, the label."""
    ids = spaces.select(F.lower("space").alias("name"), "space")
    return ids.union(spaces.filter("label is not null and label != '' and label != space").select(F.lower("label"), "space")).distinct()


def entity_names(employees: DataFrame) -> DataFrame:
    """entity, name from (id, name): the lower-cased name and id."""
    return employees.select(F.col("id").alias("entity"), F.explode(F.array(F.lower("name"), F.lower(F.col("id").cast("string")))).alias("name")).filter("name != ''").distinct()


def spaces_named(texts: DataFrame, names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """fact_id, named: the sorted spaces whose name stands anywhere in the text, in any case; texts that name none have no row."""
    found = names.filter("name != ''").limit(most + 1).collect()
    if len(found) > most:
        hit = texts.join(names.filter("name != ''"), F.contains(F.lower("text"), F.col("name"))).select("fact_id", "space")
        return hit.groupBy("fact_id").agg(F.array_sort(F.collect_set("space")).alias("named"))
    by_name: dict[str, set[str]] = {}
    for r in found:
        by_name.setdefault(r["name"], set()).add(r["space"])

    def search(batches):
        automaton = ahocorasick.Automaton()
        for name, spaces in by_name.items():
            automaton.add_word(name, spaces)
        if by_name:
            automaton.make_automaton()
        for b in batches:
            named = []
            for t in b.column(1).to_pylist():
                here: set[str] = set()
                for _, spaces in automaton.iter((t or "").lower()) if by_name else ():
                    here |= spaces
                named.append(sorted(here) or None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(named, pa.list_(pa.string()))], names=["fact_id", "named"])

    kind = texts.schema["fact_id"].dataType.simpleString()
    return texts.select("fact_id", "text").mapInArrow(search, f"fact_id {kind}, named array<string>").filter("named is not null")


def claims_of(facts: DataFrame, about: DataFrame, named: DataFrame, names: DataFrame) -> DataFrame:
    """fact_id, entity, space: the atomic claims of (fact_id, level, space, text).

    Every entity of a fact (``about``: fact_id, entity) that the text names, or that has no name, is placed in each space
    the text names; a level-0 fact places its entities in its own space whatever it says.
    """
    own = facts.filter("level = 0").select("fact_id", "space").join(about, "fact_id").select("fact_id", "entity", "space")
    # only texts that name a space are looked through for their people
    rows = facts.select("fact_id", F.lower("text").alias("low")).join(named, "fact_id").join(about, "fact_id")
    rows = rows.join(names.withColumnRenamed("entity", "n_entity"), F.col("entity") == F.col("n_entity"), "left")
    rows = rows.filter(F.col("name").isNull() | F.contains("low", F.col("name")))
    return own.union(rows.select("fact_id", "entity", F.explode("named").alias("space"))).distinct()


def widened(req: Column, named: Column) -> Column:
    """What the claim-aware gate requires: what the fact rests on, and what its text names."""
    return F.array_sort(F.array_union(req, F.coalesce(named, F.array().cast("array<string>"))))


def names_but_does_not_rest_on(req: Column, named: Column) -> Column:
    return F.array_except(F.coalesce(named, F.array().cast("array<string>")), req)


def over_restricted(facts: DataFrame, perms: DataFrame) -> DataFrame:
    """level, n_allowed, n_over: (fact, principal) pairs that the rule on evidence allows, and those of them that the claim-aware gate withholds.

    Counted over distinct (req, widened) and distinct permission sets.
    """
    rows, n = audiences(facts.withColumn("space", F.lit(None).cast("string")), perms, "level", "widened", also="widened"), F.col("n_facts")
    out = rows.groupBy("level").agg(F.sum(n * F.col("ok")).alias("n_allowed"), F.sum(n * (F.col("ok") - F.col("ok_also"))).alias("n_over"))
    return out.filter("n_allowed > 0")


def prose_channel(facts: DataFrame) -> DataFrame:
    """level, n_facts, n_own, n_foreign: facts (level, space, named) whose text names their own space, and another one."""
    none = F.array().cast("array<string>")
    named = F.coalesce("named", none)
    return facts.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_facts"), F.count_if(F.array_contains(named, F.col("space"))).alias("n_own"), F.count_if(F.size(F.array_except(named, F.array("space"))) > 0).alias("n_foreign")
    )
