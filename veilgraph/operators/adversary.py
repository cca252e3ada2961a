"""What an asker can rebuild from what may be read, and what it costs to stop it.

All principals at once: the rules run keyed by the signature of what a principal may read, so principals
with the same spaces share the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import counting
from . import derivation as D
from .loops import settle


def visible(facts0: DataFrame, permitted: DataFrame, by: str = "principal") -> DataFrame:
    """by, entity, space, fact_id, ord: the level-0 facts each principal (or set of spaces) may read."""
    return facts0.join(permitted.select(by, "space"), "space")


def reconstruct(seen: DataFrame, by: str = "principal") -> dict[str, DataFrame]:
    """The claims each ``by`` can rebuild, by running the derivation rules over ``seen``: persons, pairs, clusters."""
    person = D.person_support(seen, (by,))
    pair = D.pairs(person, (by,))
    return {"person": person, "pair": pair, "cluster": D.clusters(pair, (by,))}


def rebuilt_claims(seen: DataFrame, by: str = "principal") -> DataFrame:
    """by, claim of everything rebuilt above level 0."""
    r = reconstruct(seen, by)
    return (
        r["person"].filter("nth = 1").select(by, F.col("fact_id").alias("claim"))
        .unionByName(r["pair"].select(by, F.concat_ws("|", F.lit("pair"), "a", "b").alias("claim")))
        .unionByName(r["cluster"].select(by, F.concat_ws("|", F.lit("cluster"), "a", "b", "c").alias("claim")))
    )


def phantom_denials(denied: DataFrame, rebuilt: DataFrame, by: str = "principal") -> DataFrame:
    """``denied`` (by, claim, level) with phantom: whether the refused claim can be rebuilt all the same."""
    r = rebuilt.select(by, "claim", F.lit(True).alias("hit")).distinct()
    return denied.join(r, [by, "claim"], "left").withColumn("phantom", F.coalesce("hit", F.lit(False))).drop("hit")


def span_costs(seen: DataFrame, by: str = "principal") -> DataFrame:
    """by, entity, a, b, cost, side: the fewest facts whose removal ends an entity's span of a and b."""
    n = seen.groupBy(by, "entity", "space").agg(F.count(F.lit(1)).alias("n"))
    x, y = n.toDF(by, "entity", "a", "na"), n.toDF(by, "entity", "b", "nb")
    return x.join(y, [by, "entity"]).filter("a < b").select(
        by, "entity", "a", "b", F.least("na", "nb").alias("cost"), F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("side")
    )


def pair_cuts(costs: DataFrame, by: str = "principal") -> DataFrame:
    """by, a, b, cost: the sum of the spans' costs but the dearest; 0 below two spans."""
    g = costs.groupBy(by, "a", "b").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("cost").alias("total"), F.max("cost").alias("dearest"))
    return g.select(by, "a", "b", "n_spans", F.when(F.col("n_spans") >= 2, F.col("total") - F.col("dearest")).otherwise(F.lit(0)).alias("cost"))


def cluster_cuts(cuts: DataFrame, clusters: DataFrame, by: str = "principal") -> DataFrame:
    """by, a, b, c, cost: the cheapest of a cluster's three pair cuts; a pair without spans costs nothing."""

    def side(x, y, name):
        return cuts.select(by, F.col("a").alias(x), F.col("b").alias(y), F.col("cost").alias(name))

    out = clusters
    for x, y, name in (("a", "b", "c1"), ("a", "c", "c2"), ("b", "c", "c3")):
        out = out.join(side(x, y, name), [by, x, y], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(by, "a", "b", "c", F.least(zero("c1"), zero("c2"), zero("c3")).alias("cost"))


def withheld(seen: DataFrame, costs: DataFrame, by: str = "principal") -> DataFrame:
    """by, a, b, fact_id: the facts that a pair's cut withholds, all spans but the dearest (ties: the least entity stands)."""
    w = Window.partitionBy(by, "a", "b").orderBy(F.desc("cost"), "entity")
    cut = costs.withColumn("rank", F.row_number().over(w)).filter("rank > 1").select(by, "a", "b", "entity", F.col("side").alias("space"))
    return cut.join(seen.select(by, "entity", "space", "fact_id"), [by, "entity", "space"]).select(by, "a", "b", "fact_id")


def cuts_hold(seen: DataFrame, pairs: DataFrame, by: str = "principal") -> DataFrame:
    """by, a, b, holds, n_withheld: each pair's cut, checked by removing its facts and deriving the pair again."""
    case = F.concat_ws("|", F.col(by).cast("string"), "a", "b")
    costs = span_costs(seen, by)
    gone = withheld(seen, costs.join(pairs.select(by, "a", "b"), [by, "a", "b"], "left_semi"), by).withColumn("case", case)
    # of entities that do not stand in both spaces of a pair, no fact matters to it
    both = costs.select(by, "a", "b", "entity")
    each = pairs.select(by, "a", "b", case.alias("case")).join(both, [by, "a", "b"]).join(seen, [by, "entity"])
    left = each.join(gone.select("case", "fact_id").distinct(), ["case", "fact_id"], "left_anti")
    again = D.pairs(D.person_support(left.select("case", "entity", "space", "fact_id", "ord"), ("case",)), ("case",))
    hit = again.select("case", "a", "b", F.lit(True).alias("still"))
    n = gone.groupBy("case").agg(F.count_distinct("fact_id").alias("n_withheld"))
    return (
        pairs.select(by, "a", "b", case.alias("case")).join(hit, ["case", "a", "b"], "left").join(n, "case", "left")
        .select(by, "a", "b", F.col("still").isNull().alias("holds"), F.coalesce("n_withheld", F.lit(0)).alias("n_withheld"))
    )


def within(sets: DataFrame, pairs: DataFrame, by: str = "sig") -> DataFrame:
    """``pairs`` (a, b, ...) for every set (by, names) that holds both spaces."""
    one = sets.select(by, F.explode("names").alias("a"))
    return one.join(pairs, "a").join(one.withColumnRenamed("a", "b"), [by, "b"])


def rebuilt_pairs(facts0: DataFrame, sets: DataFrame, by: str = "sig") -> DataFrame:
    """by, a, b, n_people: what :func:`reconstruct` finds for every set of spaces (by, names), without the facts that each set may read.

    People who span a and b do so for every set with both, but for the six spaces that the rule looks at: with seven spaces or more, a
    person is left out where six others in the set come before the later of the two. These are counted per set, and taken off.
    """
    first = facts0.groupBy("entity", "space").agg(F.min("ord").alias("ord")).filter("space is not null and entity is not null")
    path = F.transform(F.array_sort(F.collect_list(F.struct("ord", "space"))), lambda x: x["space"])
    paths = settle(first.groupBy("entity").agg(path.alias("want")).filter("size(want) >= 2").groupBy("want").agg(F.count(F.lit(1)).alias("n")))
    x = paths.select("want", "n", F.explode("want").alias("a"))
    every = x.select("a", F.explode("want").alias("b"), "n").filter("a < b").groupBy("a", "b").agg(F.sum("n").alias("n_every")).filter("n_every >= 2")
    every = settle(every)
    out = within(sets, every, by)
    most = D.MOST_SPACES
    late = paths.filter(F.size("want") > most)
    if not late.isEmpty():

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            t, less = counting.Sets(right["names"]), {}
            for want, n in zip(left["want"].to_pylist(), left["n"].to_pylist()):
                before, masks = np.zeros(t.size, np.int32), []
                for j, space in enumerate(want):
                    mask = np.unpackbits(t.bits(space), count=t.size)
                    if j >= most:
                        at = np.flatnonzero(mask & (before >= most))
                        for i in range(j) if len(at) else ():
                            hit = at[masks[i][at] == 1]
                            if len(hit):
                                pair = (min(want[i], space), max(want[i], space))
                                less.setdefault(pair, np.zeros(t.size, np.int64))[hit] += n
                    masks.append(mask)
                    before += mask
            ids, a, b, n_less = [], [], [], []
            for (x_, y_), n in less.items():
                hit = np.flatnonzero(n)
                ids.append(t.order[hit])
                a += [x_] * len(hit)
                b += [y_] * len(hit)
                n_less.append(n[hit])
            join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            return pa.table({by: right[by].take(pa.array(join(ids))), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "n_less": join(n_less)})

        wide = settle(sets.filter(F.size("names") > most))
        less = counting.tiled(late, wide, run, f"{by} {sets.schema[by].dataType.simpleString()}, a string, b string, n_less long", rows=1 << 10)
        out = out.join(less.groupBy(by, "a", "b").agg(F.sum("n_less").alias("n_less")), [by, "a", "b"], "left")
        return out.select(by, "a", "b", (F.col("n_every") - F.coalesce("n_less", F.lit(0))).alias("n_people")).filter("n_people >= 2")
    return out.select(by, "a", "b", F.col("n_every").alias("n_people"))


def spans_everywhere(facts0: DataFrame) -> DataFrame:
    """entity, a, b, cost, side of :func:`span_costs` for one who may read everything; for others the same, where they hold both spaces."""
    return span_costs(facts0.withColumn("all", F.lit(0)), "all").drop("all")


def cheapest(spans: DataFrame) -> DataFrame:
    """a, b, n_spans, total, dearest, cost of :func:`pair_cuts`, from the spans (entity, a, b, cost)."""
    g = spans.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("cost").alias("total"), F.max("cost").alias("dearest"))
    return settle(g.withColumn("cost", F.when(F.col("n_spans") >= 2, F.col("total") - F.col("dearest")).otherwise(F.lit(0))))


def cut_sides(spans: DataFrame) -> DataFrame:
    """a, b, entity, space: whose facts in which space a pair's cut withholds, as in :func:`withheld`."""
    key = F.struct((-F.col("cost")).alias("minus"), "entity")
    stays = spans.groupBy("a", "b").agg(F.min(key)["entity"].alias("stays"))
    return spans.join(stays, ["a", "b"]).filter("entity != stays").select("a", "b", "entity", F.col("side").alias("space"))


def cuts_hold_everywhere(facts0: DataFrame, spans: DataFrame) -> DataFrame:
    """a, b, holds, n_withheld of :func:`cuts_hold` for all pairs that people span: the facts are removed, and the pair derived again.

    It is derived from the two spaces alone. Further spaces only take people out (the six first of each), so what holds there holds for every set.
    """
    gone = settle(cut_sides(spans))
    known = facts0.select("entity", "space", "fact_id", "ord")
    withheld_ = settle(gone.join(known.drop("ord"), ["entity", "space"]).select("a", "b", "fact_id").distinct())
    sides = spans.select("a", "b", "entity", F.explode(F.array("a", "b")).alias("space"))
    left = sides.join(known, ["entity", "space"]).join(withheld_, ["a", "b", "fact_id"], "left_anti").withColumn("case", F.concat_ws("|", "a", "b"))
    again = D.pairs(D.person_support(left.select("case", "entity", "space", "fact_id", "ord"), ("case",)), ("case",)).select("a", "b", "case", F.lit(True).alias("still"))
    again = again.filter(F.col("case") == F.concat_ws("|", "a", "b")).drop("case")
    n = withheld_.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_withheld"))
    out = spans.select("a", "b").distinct().join(again, ["a", "b"], "left").join(n, ["a", "b"], "left")
    return settle(out.select("a", "b", F.col("still").isNull().alias("holds"), F.coalesce("n_withheld", F.lit(0)).alias("n_withheld")))


def evidence_lost(facts0: DataFrame, sets: DataFrame, spans: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """n_held, n_withheld: facts that each of the sets (sig, names, n) may read, and those that the cuts of all pairs it rebuilds (sig, a, b) withhold."""
    pair = F.concat_ws("\u0001", "a", "b")
    docs = facts0.groupBy("space").agg(F.count(F.lit(1)).alias("docs"))
    held = sets.select(F.explode("names").alias("space"), "n").join(docs, "space").agg(F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0)).alias("n_held"))
    cases = cut_sides(spans).groupBy("entity", "space").agg(F.collect_set(pair).alias("pairs"))
    cases = cases.join(facts0.select("entity", "space", "fact_id"), ["entity", "space"]).groupBy("fact_id").agg(counting.wanted(F.flatten(F.collect_set("pairs"))).alias("want"))
    cases = settle(cases.groupBy("want").agg(F.count(F.lit(1)).alias("times")))
    # a fact is withheld from a set that rebuilds any pair whose cut takes it
    by_pairs = rebuilt.groupBy("sig").agg(F.collect_set(pair).alias("names")).join(sets.select("sig", "n"), "sig").groupBy("names").agg(F.sum("n").alias("n"))
    told = counting.holders(cases.select("want"), settle(by_pairs.withColumn("names", F.array_sort("names")).groupBy("names").agg(F.sum("n").alias("n"))))
    return held.crossJoin(cases.join(told, "want").agg(F.coalesce(F.sum(F.col("times") * F.col("n_any")), F.lit(0)).alias("n_withheld")))
