"""What sets of spaces rebuild, counted without the facts that each may read, against the rules run per set."""

import random

from pyspark.sql import functions as F

from veilgraph.operators import adversary as A
from veilgraph.operators import counting, derivation


def _case(spark, seed):
    """People in up to twelve of twelve spaces, and sets of one to twelve of them."""
    rng = random.Random(seed)
    spaces = "abcdefghijkl"
    facts = []
    for entity in range(40):
        for space in rng.sample(spaces, rng.choice([1, 2, 3, 7, 9, 12])):
            facts += [(entity, space) for _ in range(rng.randint(1, 3))]
    rng.shuffle(facts)
    facts0 = spark.createDataFrame([(f"f{i}", e, s, i) for i, (e, s) in enumerate(facts)], "fact_id string, entity int, space string, ord int")
    kept = sorted({tuple(sorted(rng.sample(spaces, k))) for k in (1, 2, 3, 6, 7, 8, 9, 10, 11, 12) for _ in range(3)})
    sets = spark.createDataFrame([(f"s{i}", list(s), i % 3 + 1) for i, s in enumerate(kept)], "sig string, names array<string>, n long")
    return facts0, sets, A.visible(facts0, sets.select("sig", F.explode("names").alias("space")), "sig").cache()


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pairs_and_clusters_are_those_of_the_rules(spark, monkeypatch):
    monkeypatch.setattr(counting, "SETS", 7)
    facts0, sets, seen = _case(spark, 1)
    got, want = A.rebuilt_pairs(facts0, sets), A.reconstruct(seen, "sig")
    assert _rows(got, "sig", "a", "b", "n_people") == _rows(want["pair"], "sig", "a", "b", "n_people")
    assert _rows(derivation.clusters(got, ("sig",)), "sig", "a", "b", "c") == _rows(want["cluster"], "sig", "a", "b", "c")


def test_cuts_of_a_pair_are_the_same_for_all_who_hold_both_spaces(spark):
    facts0, sets, seen = _case(spark, 2)
    got = A.within(sets, A.cheapest(A.spans_everywhere(facts0)))
    assert _rows(got, "sig", "a", "b", "n_spans", "cost") == _rows(A.pair_cuts(A.span_costs(seen, "sig"), "sig"), "sig", "a", "b", "n_spans", "cost")


def test_cuts_hold_and_withhold_as_they_do_per_set(spark):
    facts0, sets, seen = _case(spark, 3)
    spans, rebuilt = A.spans_everywhere(facts0), A.rebuilt_pairs(facts0, sets)
    pairs = A.reconstruct(seen, "sig")["pair"].select("sig", "a", "b")
    got = rebuilt.join(A.cuts_hold_everywhere(facts0, spans), ["a", "b"])
    cols = ("sig", "a", "b", "holds", "n_withheld")
    assert _rows(got, *cols) == _rows(A.cuts_hold(seen, pairs, "sig"), *cols)
    costs = A.span_costs(seen, "sig").join(pairs, ["sig", "a", "b"], "left_semi")
    gone = A.withheld(seen, costs, "sig").select("sig", "fact_id").distinct().join(sets, "sig").agg(F.sum("n")).first()[0]
    held = seen.join(sets, "sig").agg(F.sum("n")).first()[0]
    assert tuple(A.evidence_lost(facts0, sets, spans, rebuilt).first()) == (held, gone)
