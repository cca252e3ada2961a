"""Logs and covers written in streams of batches, not in a Python call for every chain or case."""

from veilgraph.operators import attack, audit


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chains_go_on_over_batches(spark):
    rows = [(f"c{i % 5}", i // 5, f"t{i}", "allow", f"p{i % 5}", [f"f{i}", "a"]) for i in range(60)]
    entries = spark.createDataFrame(rows, "chain string, seq long, at string, decision string, principal string, facts array<string>")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        first = audit.record(entries.filter("seq < 7"))
        assert "MapInArrow" in _plan(first) and "FlatMapGroups" not in _plan(first)
        whole = first.unionByName(audit.record(entries.filter("seq >= 7"), first)).localCheckpoint()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert {(r.chain, r.entries, r.broken_at) for r in audit.verify(whole).collect()} == {(f"c{i}", 12, None) for i in range(5)}
    assert {r.seq for r in whole.collect()} == set(range(12))


def test_covers_of_facts_that_say_the_same(spark):
    says = {"a": "xy", "b": "xy", "c": "yz", "d": "z", "e": "q", "f": "q"}
    rows = [(k, claim, f) for k in range(3) for f, cl in says.items() for claim in cl]
    out = attack.witness_cover(spark.createDataFrame(rows, "case int, claim string, fact_id string"))
    assert "FlatMapGroups" not in _plan(out)
    assert {(r.case, r.size, r.witnesses) for r in out.collect()} == {(str(k), 3, "a,c,e") for k in range(3)}
