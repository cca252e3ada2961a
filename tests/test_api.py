"""The service surface, dense projection and evaluation on a small world."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph import api
from veilgraph.operators import dense, evaluation


@pytest.fixture(scope="module")
def service(spark):
    facts = spark.createDataFrame(
        [("f1", 0, "A", "billing migration plan started", ["A"]), ("f2", 0, "B", "billing migration rollout finished", ["B"]), ("d1", 1, "A", "billing migration spans areas", ["A", "B"])],
        "fact_id string, level int, space string, text string, req array<string>",
    )
    permitted = spark.createDataFrame([("p", "A"), ("q", "A"), ("q", "B")], "principal string, space string")
    edges = spark.createDataFrame([("d1", "f1"), ("d1", "f2")], "fact_id string, support_id string")
    return api.Service(facts, permitted, edges)


def test_ask_and_check(spark, service):
    got = {r.doc_id: (r.admitted, r.missing) for r in service.ask_as("p", "What about the billing migration?").collect()}
    assert got == {"f1": (True, None), "f2": (False, ["B"]), "d1": (False, ["B"])}
    assert not any(r.admitted for r in service.ask_as("nobody", "billing migration").collect())
    asked = spark.createDataFrame(
        [("q", "d1", None, None), ("p", "d1", None, None), ("p", "new", ["A"], None), ("p", "new2", None, ["f1"]), ("p", "new3", None, ["f1", "gone"]), ("p", "new4", None, None), ("x", "f1", None, None)],
        "principal string, fact_id string, requires array<string>, rests_on array<string>",
    )
    ok = {(r.principal, r.fact_id): r.admitted for r in service.check_admissible(asked).collect()}
    assert ok == {("q", "d1"): True, ("p", "d1"): False, ("p", "new"): True, ("p", "new2"): True, ("p", "new3"): False, ("p", "new4"): False, ("x", "f1"): False}


def test_risk_and_derivation(service):
    assert [(r.fact_id, r.audience) for r in service.risk_surface().collect()] == [("d1", 1)]
    assert '"f1"' in str(service.derivation("d1").collect()[0].chain)


def test_projection_is_unit_and_separates(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "delta epsilon"), (4, "")], "doc_id long, text string")
    v = {r.doc_id: np.array(r.v) for r in dense.project(docs).collect()}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[1]) - 1) < 1e-9 and not v[4].any() and v[1] @ v[3] < 0.5


def test_evaluation_sees_the_same_candidates(spark, service):
    hits = spark.createDataFrame([(0, "f1", 1.0), (0, "d1", 0.5), (1, "f2", 1.0)], "query_id long, doc_id string, score double")
    t = evaluation.trials(hits, service.facts, service.perms)
    s = {r.system: (r.trials, r.leaked) for r in evaluation.summary(t).collect()}
    assert s == {"ungated": (4, 2), "document-acl": (4, 1), "derivation-aware": (4, 0)} and evaluation.parity(t).isEmpty()
    about = spark.createDataFrame([("f1", "ann", 0), ("d1", "bob", 1)], "fact_id string, entity string, level int")
    assert [r.answer for r in dense.answer_people(hits, about).filter("query_id = 0").collect()] == [["bob"]]


def test_red_team_gains_every_claim_of_an_admitted_fact(spark):
    rows = [("t", "ann", "A"), ("t", "ann", "B"), ("t", "ann", "C"), ("w1", "ann", "A"), ("w1", "ann", "B"), ("w2", "ann", "C"), ("u", "bob", "A"), ("u", "bob", "B")]
    claims = spark.createDataFrame(rows, "fact_id string, entity string, space string")
    facts = spark.createDataFrame([("t", 1, ["A", "B", "C"]), ("w1", 0, ["A"]), ("w2", 0, ["C"]), ("u", 1, ["A", "B"])], "fact_id string, level int, req array<string>")
    sets = spark.createDataFrame([("all but b", ["A", "C"]), ("a", ["A"]), ("none", [])], "sig string, perm array<string>")
    got = {(r.sig, r.target): (r.turns, round(r.coverage, 3), r.reconstructed) for r in evaluation.red_team(claims, facts, sets).collect()}
    assert got["all but b", "t"] == (2, 1.0, True) and got["a", "t"] == (2, 0.667, False) and got["none", "t"] == (1, 0.0, False)
    assert got["a", "u"] == (1, 0.0, False) and len(got) == 6
    assert evaluation.red_team(claims, facts, sets, sequences=2).count() == 2


def test_answers_of_every_kind(spark):
    q = spark.createDataFrame(
        [(1, "PR", True, '["https://x/a/pull/7"]'), (2, "url", True, '["http://y/z"]'), (3, "company", True, '["Acme"]'), (4, "person", True, '["ann"]'), (5, "essay", True, '["x"]'), (6, "url", False, '["u"]'), (7, "url", True, "text")],
        "query_id long, type string, answerable boolean, ground_truth string",
    )
    asked = evaluation.scoreable(q)
    assert {r.query_id: r.kind for r in asked.collect()} == {1: "pr", 2: "url", 3: "company", 4: "person"}
    sources = spark.createDataFrame([("s1", "slack", None, "see https://x/a/pull/7, ok"), ("s2", "url", "http://y/z", "Acme was here http://y/q)."), ("s3", "pr", "https://x/b/pull/8", "")], "doc_id string, kind string, locator string, text string")
    hits = spark.createDataFrame([(i, s, 1.0) for i in (1, 2, 3, 4) for s in ("s1", "s2", "s3")], "query_id long, doc_id string, score double")
    about = spark.createDataFrame([("s1", "ann", 0)], "fact_id string, entity string, level int")
    customers = spark.createDataFrame([("Acme",), ("Other",)], "name string")
    got = evaluation.answers(asked, hits, sources, about, customers)
    assert {r.query_id: r.answer for r in got.collect()} == {1: ["https://x/a/pull/7", "https://x/b/pull/8"], 2: ["http://y/q", "http://y/z", "https://x/a/pull/7"], 3: ["Acme"], 4: ["ann"]}
    u = evaluation.utility(asked, got).collect()[0]
    assert (u.n, u.recall) == (4, 1.0) and abs(u.precision - (0.5 + 1 / 3 + 2) / 4) < 1e-3


def test_links(spark):
    row = spark.sql("SELECT 'see https://a.b/c), and http://x.y.' AS t").select(dense.links_in(F.col("t")).alias("u")).collect()[0]
    assert row.u == ["https://a.b/c", "http://x.y"]
