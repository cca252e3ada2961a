"""Aggregation attacks: refused facts whose atomic claims are all carried by disclosed ones."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counting import Sets, counted_sets, holders, tiled, wanted
from .loops import settle


GATES = ("ungated", "document-acl", "derivation-aware", "claim-aware")


def census(claims: DataFrame, facts: DataFrame, perms: DataFrame) -> DataFrame:
    """gate, level, denied, leaks, coverage_sum over refused derived facts that claim anything, and principals.

    ``claims``: fact_id, entity, space (a fact asserts that an entity is in a space); ``facts``: fact_id, level, space, req, widened. Principals
    count by the set of spaces they may read. Facts that carry a claim are grouped by what the gates look at, and targets by their carriers; each
    kind of target meets the sets as bitmaps (:mod:`counting`), and no pair of a target and a set becomes a row.
    """
    sets = counted_sets(perms)
    said = settle(claims.select("fact_id", "entity", F.col("space").alias("w_space")).distinct())
    # what the gates look at in a carrier; two carriers are enough to know whether one beside the target itself asserts the claim
    kinds = said.join(facts.select("fact_id", "space", "req", "widened"), "fact_id")
    kinds = kinds.groupBy("entity", "w_space", "space", "req", "widened").agg(F.min("fact_id").alias("one"), F.max("fact_id").alias("two"))
    targets = facts.filter("level > 0").select(F.col("fact_id").alias("target"), "level", F.col("req").alias("t_req"))
    wanted_ = targets.join(said.withColumnRenamed("fact_id", "target"), "target")
    other = (F.col("one") != F.col("target")) | (F.col("two") != F.col("target"))
    carrier = F.when(other, F.struct("space", "req", "widened"))
    each = wanted_.join(kinds, ["entity", "w_space"], "left").groupBy("target", "level", "t_req", "entity", "w_space").agg(F.array_sort(F.collect_set(carrier)).alias("carriers"))
    # targets alike in all that is looked at are counted together
    cases = each.groupBy("target", "level", "t_req").agg(F.array_sort(F.collect_list("carriers")).alias("carried"))
    cases = cases.groupBy("level", F.coalesce("t_req", F.array(F.lit(None).cast("string"))).alias("want"), "carried").agg(F.count(F.lit(1)).alias("n_targets"))
    cases = settle(cases.select("level", "want", "n_targets", F.size("carried").alias("n_claims"), F.to_json("carried").alias("carried")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s, total = Sets(right["names"], right["n"].to_numpy()), {}
        nobody = np.zeros_like(s.full)
        rows = zip(*[left[c].to_pylist() for c in ("level", "want", "n_targets", "n_claims", "carried")])
        for level, want, n_targets, n_claims, carried in rows:
            refused = s.full & ~s.all_of(want)
            denied = s.count(refused)
            if not denied:
                continue
            whole, hits = dict.fromkeys(GATES, refused), dict.fromkeys(GATES, 0)
            for carriers in json.loads(carried):
                opened = {g: nobody for g in GATES}
                for c in carriers:
                    req, wide = c.get("req"), c.get("widened")
                    opened["ungated"] = s.full
                    opened["document-acl"] = opened["document-acl"] | s.bits(c.get("space"))
                    opened["derivation-aware"] = opened["derivation-aware"] | (nobody if req is None else s.all_of(req))
                    opened["claim-aware"] = opened["claim-aware"] | (nobody if wide is None else s.all_of(wide))
                for g in GATES:
                    hits[g] += s.count(refused & opened[g])
                    whole[g] = whole[g] & opened[g]
            for g in GATES:
                t = total.setdefault((g, level, n_claims), [0, 0, 0])
                for k, n in enumerate((denied, s.count(whole[g]), hits[g])):
                    t[k] += n * n_targets
        rows = [(*k, *v) for k, v in total.items()]
        kinds_ = (("gate", pa.string()), ("level", pa.int32()), ("n_claims", pa.int32()), ("denied", pa.int64()), ("leaks", pa.int64()), ("hits", pa.int64()))
        return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds_)})

    out = tiled(cases, sets, run, "gate string, level int, n_claims int, denied long, leaks long, hits long", at=lambda n: F.pmod(F.xxhash64("carried"), F.lit(n)).cast("string"))
    out = out.groupBy("gate", "level", "n_claims").agg(F.sum("denied").alias("denied"), F.sum("leaks").alias("leaks"), F.sum("hits").alias("hits"))
    return out.groupBy("gate", "level").agg(F.sum("denied").alias("denied"), F.sum("leaks").alias("leaks"), F.round(F.sum(F.col("hits") / F.col("n_claims")), 6).alias("coverage_sum"))


def claim_locality(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """level, n_claims, n_local: claims whose space the asserting fact requires."""
    rows = facts.select("fact_id", "level", "req").join(claims, "fact_id")
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.array_contains("req", F.col("space"))).alias("n_local"))


def theorem1(edges: DataFrame, facts: DataFrame, all_req: DataFrame, perms: DataFrame) -> DataFrame:
    """n_held, n_violations: sets that may read every support of a fact but not the fact."""
    support = edges.join(all_req.toDF("support_id", "s_req"), "support_id").select("fact_id", "s_req")
    union = support.groupBy("fact_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s_req")))).alias("s_req"))
    rows = settle(union.join(facts.select("fact_id", "req"), "fact_id").select("s_req", "req").distinct().select(wanted(F.col("s_req")).alias("s"), wanted(F.col("s_req"), F.col("req")).alias("both")))
    told = holders(rows.select(F.explode(F.array("s", "both")).alias("want")), settle(perms.select(F.col("perm").alias("names"), F.lit(1).cast("long").alias("n")).distinct())).select("want", "n_all")
    rows = rows.join(told.toDF("s", "n_held"), "s").join(told.toDF("both", "n_both"), "both")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(zero(F.col("n_held")).alias("n_held"), zero(F.col("n_held") - F.col("n_both")).alias("n_violations"))


def witness_cover(candidates: DataFrame) -> DataFrame:
    """case, size, witnesses: a greedy set cover per case over (case, claim, fact_id); ties go to the least fact."""

    def cover(rows) -> list:
        by_fact: dict = {}
        for x in rows:
            by_fact.setdefault(x["fact_id"], set()).add(x["claim"])
        left, chosen = {x["claim"] for x in rows}, []
        while left:
            best = min(by_fact, key=lambda f: (-len(by_fact[f] & left), f))
            chosen.append(best)
            left -= by_fact.pop(best)
        return chosen

    def run(batches):
        for b in batches:
            chosen = [cover(rows) for rows in b.column(1).to_pylist()]
            out = [b.column(0).cast(pa.string()), pa.array([len(c) for c in chosen], pa.int64()), pa.array([",".join(map(str, c)) for c in chosen], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["case", "size", "witnesses"])

    # of facts that say the same of a case, the least is chosen first, and none of the others after it
    says = candidates.groupBy("case", "fact_id").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    least = says.groupBy("case", "claims").agg(F.min("fact_id").alias("fact_id"))
    one = F.explode("claims").alias("claim")
    each = least.select("case", "fact_id", one).groupBy("case").agg(F.collect_list(F.struct("claim", "fact_id")).alias("rows"))
    return each.mapInArrow(run, "case string, size long, witnesses string")


def replay(probes: DataFrame, cache: DataFrame) -> DataFrame:
    """``probes`` (model, prompt) with the cached answer of a model, by a digest of both; no model is called."""
    key = F.substring(F.sha2(F.concat_ws(" ", "model", "prompt"), 256), 1, 32)
    return probes.withColumn("key", key).join(cache.select("key", "answer"), "key", "left").drop("key")


def confusion(answers: DataFrame) -> DataFrame:
    """tp, fp, tn, fn, recall, fpr, advantage, degenerate over (truth, said), booleans; unanswered rows do not count."""
    n = lambda t, s, name: F.count_if((F.col("truth") == t) & (F.col("said") == s)).alias(name)
    c = answers.filter("said is not null").agg(n(True, True, "tp"), n(False, True, "fp"), n(False, False, "tn"), n(True, False, "fn"))
    recall, fpr = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))
    return c.select("*", F.round(recall, 6).alias("recall"), F.round(fpr, 6).alias("fpr"), F.round(recall - fpr, 6).alias("advantage"), (((F.col("tp") + F.col("fp")) == 0) | ((F.col("tn") + F.col("fn")) == 0)).alias("degenerate"))
