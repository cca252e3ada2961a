"""Paths, samples and the replayed adversary."""

from veilgraph.operators import attack, graph, sampling


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e")], "a string, b string")
    got = {r.node: (r.path, r.depth) for r in graph.paths_from(edges, spark.createDataFrame([("a",)], "source string")).collect()}
    assert got["c"] == (["a", "b", "c"], 2) and got["e"][1] == 3 and got["a"][1] == 0
    asked = spark.createDataFrame([("a", "e"), ("e", "a")], "source string, target string")
    assert {(r.source, r.reached) for r in graph.reachable(edges, asked).collect()} == {("a", True), ("e", False)}
    leaves = spark.createDataFrame([("c", "S", "u1"), ("e", "S", "u2"), ("d", "T", None)], "fact_id string, space string, locator string")
    want = spark.createDataFrame([("a", "S"), ("a", "T")], "fact_id string, space string")
    assert {(r.space, r.locator) for r in graph.source_of(edges, leaves, want).collect()} == {("S", "u1"), ("T", None)}


def test_samples_and_replay(spark):
    rows = spark.range(100)
    assert [r.id for r in sampling.seeded(rows, "id", 5, 1).collect()] == [r.id for r in sampling.seeded(rows.repartition(7), "id", 5, 1).collect()]
    assert sorted(r.id for r in sampling.spread(rows, ["id"], 3).collect()) == [0, 49, 99]
    member = spark.createDataFrame([(p, s) for s, people in {"A": "xyz", "B": "xy", "C": "z", "D": "q"}.items() for p in people], "principal string, space string")
    assert sampling.overlapping_spaces(member, 3) == ["A", "B", "C"]
    answers = spark.createDataFrame([(True, True), (True, False), (False, False), (False, None)], "truth boolean, said boolean")
    r = attack.confusion(answers).collect()[0]
    assert (r.tp, r.fp, r.tn, r.fn, r.recall, r.fpr, r.degenerate) == (1, 0, 1, 1, 0.5, 0.0, False)
