"""From JSON files to facts, and what a run writes."""

import json

import pytest
from pyspark.sql import functions as F

from veilgraph import api, build
from veilgraph.operators import contest, dense, evaluation, policy, provenance
from veilgraph.sources import adapter, corpus, sinks


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("org")
    (d / "products").mkdir()
    staff = {f"eid_00000{i}": {"name": n, "role": "r", "location": "l", "org": "o"} for i, n in enumerate(["Ann Archer", "Bob Brown", "Cat Cole", "Ann Abel"])}
    (d / "employee.json").write_text(json.dumps(staff))
    (d / "salesforce_team.json").write_text(json.dumps([{"employee_id": "eid_000002", "reports": [{"employee_id": "eid_000000"}]}]))
    (d / "customers_data.json").write_text(json.dumps({"x": {"company": "Acme"}, "y": {"name": "Beta"}, "z": {"customer": "Acme"}}))
    said = "Ann Archer agreed with Bob Brown to ship release {} of the whole system by the third of May."
    for space, team in (("Alpha", ["eid_000000", "eid_000001"]), ("Beta", ["eid_000001"]), ("Gamma", ["eid_000003"])):
        product = {
            "team": team, "customers": ["Acme"],
            "documents": [{"id": "d1", "content": said.format(space), "author": "eid_000001", "document_link": f"http://x/{space}"}],
            "meeting_transcripts": [{"id": "m1", "transcript": "Bob: Ann and I were there and nobody else came along to it.", "participants": ["eid_000000", "eid_000001"]}],
            "answerable_questions": [{"question": f"who ships {space}", "ground_truth": ["eid_000000"], "citations": ["d1"], "type": "Person"}], "unanswerable_questions": ["why"],
        }
        (d / "products" / f"{space}.json").write_text(json.dumps(product))
    return str(d)


def test_build_runs_every_stage(spark, root, tmp_path):
    built = build.build(corpus.load(spark, root))
    s = built.stats()
    assert s["accuracy"]["precision"] == 1.0 and s["accuracy"]["evaluated"] > 0 and s["mentions"] >= s["resolved"] > 0
    facts = {r.fact_id: r for r in built.facts.collect()}
    assert sum(f.level == 0 for f in facts.values()) >= 3 and facts["person:eid_000000"].req == ["Alpha", "Beta", "Gamma"]
    assert facts["pair:Alpha:Beta"].level == 2 and facts["cluster:Alpha|Beta|Gamma"].req == ["Alpha", "Beta", "Gamma"]
    assert {r.space for r in built.permitted.filter("principal = 'eid_000002'").collect()} == {"Alpha"}  # from a report
    few = build.build(corpus.load(spark, root), most_spaces=2)
    assert {r.space for r in few.facts.select("space").distinct().collect()} == {"Alpha", "Beta"}
    edges = built.edges()
    assert set(edges) == {"MEMBER_OF", "MANAGES", "IN_SPACE", "FILED_UNDER", "MENTIONS", "RESOLVES_TO", "RESTS_ON", "ABOUT"}
    corpus.write_graph(edges, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/rests_on").count() == built.rests_on.distinct().count()
    cited = provenance.citations_under(built.rests_on, built.corpus.sources.select(F.concat(F.lit("s:"), "source_id").alias("source_id"), F.col("source_id").alias("citation")))
    assert {r.citation for r in cited.filter("fact_id = 'pair:Alpha:Beta'").collect()} >= {"Alpha::d1", "Beta::d1"}


def test_command_writes_graph_facts_and_summary(spark, root, tmp_path):
    build.main([root, str(tmp_path), "--spaces", "2"])
    line = spark.read.text(f"{tmp_path}/summary").first()[0]
    summary = json.loads(line)
    assert summary["provenance"]["corpus"]["sources"] == summary["sources"] and len(summary["provenance"]["corpus"]["digest"]) == 64
    assert spark.read.parquet(f"{tmp_path}/facts").count() == sum(summary["facts"].values())


def test_sinks_and_customers(spark, root, tmp_path):
    assert {r.name for r in corpus.customers(spark, f"{root}/customers_data.json").collect()} == {"Acme", "Beta"}
    (tmp_path / "list.json").write_text('[{"name": "Gone"}, {"name": "G"}]')
    assert [r.name for r in corpus.customers(spark, str(tmp_path / "list.json")).collect()] == ["Gone"]
    sinks.write_rows(spark.range(3), f"{tmp_path}/rows")
    assert spark.read.json(f"{tmp_path}/rows").count() == 3
    people = spark.createDataFrame([("The Team met Dora Dale and Dora Dale.",), ("Data Room, Eve Ellis!",), (None,)], "text string")
    assert {r.name for r in corpus.named_people(people).collect()} == {"Dora Dale", "Eve Ellis"}


def test_snapshot_round_trip(spark, tmp_path):
    snap = {
        "owner": "o", "fetchedAt": "t", "repos": [{"name": "r1", "fullName": "o/r1", "private": True, "description": None, "collaborators": ["a"]}, {"name": "r2", "fullName": "o/r2", "private": False, "description": "", "collaborators": []}],
        "issues": [{"repo": "r1", "number": 1, "title": "T", "body": "B", "author": "a", "createdAt": "c", "url": "u", "comments": [{"author": "b", "body": "x", "createdAt": "c"}]}],
        "teams": [{"slug": "t", "name": "t", "parent": None, "members": ["b"], "repos": ["r1"]}],
    }
    (tmp_path / "s.json").write_text(json.dumps(snap))
    stats = corpus.snapshot_stats(spark, str(tmp_path / "s.json")).first().asDict()
    assert stats == {"owner": "o", "fetched_at": "t", "repos": 2, "private": 1, "public": 1, "issues": 1, "comments": 1, "teams": 1, "team_grants": 1}
    one = spark.read.schema(corpus.SNAPSHOT).option("multiLine", True).json(str(tmp_path / "s.json"))
    corpus.save_snapshot(spark, one, f"{tmp_path}/again")
    assert corpus.snapshot_stats(spark, f"{tmp_path}/again").first().asDict() == stats
    assert corpus.load_snapshot(spark, f"{tmp_path}/again").sources.count() == 1


class Tiny:
    name = "tiny"

    def __init__(self, spark):
        self.spark = spark

    def sources(self):
        return self.spark.createDataFrame([("s1", "A"), ("s2", "B")], "fact_id string, space string")

    def units(self):
        return self.spark.createDataFrame([("u1", 1, "A", ["s1", "s2"]), ("u2", 2, "A", ["u1"]), ("u3", 1, None, ["s2"]), ("u4", 1, "A", [])], "unit_id string, level int, space string, rests_on array<string>")

    def permitted(self):
        return self.spark.createDataFrame([("p", "A"), ("q", "A"), ("q", "B")], "principal string, space string")


def test_adapter_scores_systems(spark):
    c = Tiny(spark)
    total = lambda system: {r.level: (r.pairs, r.leaked, r.false_denials, r.flips, r.considered) for r in adapter.score(c, system).collect()}
    assert total(adapter.Ungated()) == {1: (6, 4, 0, 1, 1), 2: (2, 1, 0, 1, 1)}
    assert total(adapter.DocumentAcl()) == {1: (6, 3, 1, 1, 1), 2: (2, 1, 0, 1, 1)}
    assert total(adapter.DerivationAware(c)) == {1: (6, 0, 0, 1, 1), 2: (2, 0, 0, 1, 1)}


def test_service_tells_refusals_and_absences_alike(spark, root):
    built = build.build(corpus.load(spark, root))
    service = api.Service(built.facts, built.permitted, built.rests_on, built.corpus.questions)
    assert service.questions().count() == 3
    refused = service.answer_as("nobody", "release Alpha system").collect()
    absent = service.answer_as("eid_000001", "zzzqqq").collect()
    assert refused == absent and len(refused) == 1
    assert any("Alpha" in r.text for r in service.answer_as("eid_000001", "release Alpha system").collect())
    matrix = api.verdict_matrix(built.facts, service.perms, built.rests_on).filter("fact_id = 'pair:Alpha:Beta'").first()
    assert matrix.chain and set(matrix.verdicts) >= {"document-acl", "derivation-aware"}


def test_sessions_and_report_card(spark):
    rows = [("p", 1, "f1", 0, "e1", "A", ""), ("p", 1, "f2", 0, "e1", "B", ""), ("p", 2, "f1", 0, "e1", "A", ""), ("q", 1, "f1", 0, "e1", "A", "")]
    told = spark.createDataFrame(rows, "principal string, query int, fact_id string, level int, entity string, space string, claim string")
    state = {r.principal: (r.size, r.queries) for r in api.session_state(told).collect()}
    assert state == {"p": (2, 2), "q": (1, 1)}
    assert api.session_reset(told, spark.createDataFrame([("p",)], "principal string")).count() == 1
    card = dict(((a, c), s) for a, c, s in api.report_card({"policy": {"drift": 0, "commit": "old"}, "attack": {"leaks": {"claim-aware": 2}}, "model": {}}, commit="new"))
    assert len(card) == 9 and card["policy", "a policy compiled again does not drift"] == "stale"
    assert card["attack", "no leak under the claim-aware gate"] == card["model", "no probe is told true by a model"] == "fail"
    assert card["planner", "the constraint binds somewhere"] == "missing"


def test_oracle_retriever_ranks_and_falls_back(spark):
    q = spark.createDataFrame([(1, ["c2", "c1"], "x"), (2, [], "needle here")], "query_id long, citations array<string>, text string")
    support = spark.createDataFrame([("c1", "f1"), ("c2", "f2"), ("c2", "f3"), ("c1", "f2")], "citation string, fact_id string")
    docs = spark.createDataFrame([("f1", "needle"), ("f2", "other words")], "doc_id string, text string")
    got = {(r.query_id, r.doc_id): r.score for r in dense.by_citation(q, support, docs).collect()}
    assert got[1, "f2"] == 1.0 and got[1, "f3"] == 0.5 and abs(got[1, "f1"] - 1 / 3) < 1e-12 and (2, "f1") in got and len(got) == 4


def test_notice_counts_hidden_sides(spark):
    rows = [("status", "x", "done", "A", 1), ("status", "x", "late", "B", 2), ("status", "x", "lost", "C", 3), ("status", "y", "done", "A", 4)]
    claims = spark.createDataFrame(rows, "predicate string, subject string, value string, space string, ord int")
    perm = spark.createDataFrame([("one", "A"), ("two", "A"), ("two", "B"), ("all", "A"), ("all", "B"), ("all", "C")], "principal string, space string")
    got = {r.principal: r.notice for r in contest.notice(claims, perm).collect()}
    assert got == {"one": "2 sources you do not have access to disagree with this.", "two": "1 source you do not have access to disagrees with this."}


def test_probes_are_effective_and_matched(spark):
    denied = spark.createDataFrame([("p", "A", "B"), ("p", "A", "C")], "principal string, a string, b string")
    rebuilt = denied.filter("b = 'C'")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string")
    evidence = spark.createDataFrame([("p", a, b, f"f{i}", "A", f"text {i}", i % 2 == 0) for a, b in (("A", "B"), ("A", "C"), ("B", "C")) for i in range(30)], "principal string, a string, b string, fact_id string, space string, text string, mentions boolean")
    got = {(r.a, r.b): r for r in evaluation.probes(denied, rebuilt, pairs, evidence).collect()}
    assert set(got) == {("A", "B"), ("B", "C")} and got["A", "B"].truth and not got["B", "C"].truth
    assert len(got["A", "B"].evidence) == 24 and got["A", "B"].evidence[0] == "(A) text 0"


def test_hero_and_grants(spark):
    facts = spark.createDataFrame([("d1", 2, "A", ["A", "B"]), ("d2", 1, "A", ["A"])], "fact_id string, level int, space string, req array<string>")
    perms = spark.createDataFrame([("full", ["A", "B"]), ("half", ["A"]), ("none", [])], "principal string, perm array<string>")
    hits = spark.createDataFrame([(1, "d2", 1), (2, "d2", 1), (2, "d1", 2)], "query_id long, doc_id string, rank int")
    r = evaluation.hero(hits, facts, perms).collect()
    assert [(x.query_id, x.doc_id, x.entitled, x.denied) for x in r] == [(2, "d1", "full", "half")]
    sim = spark.createDataFrame([("p", "A", 4, 2, 1), ("q", "A", 4, 2, 0), ("p", "B", 0, 0, 0)], "principal string, space string, documents long, derived long, by_combination long")
    assert [tuple(x) for x in policy.widest(sim).collect()] == [("A", "p", 4, 2, 1), ("B", "p", 0, 0, 0)]
    impacts = spark.createDataFrame([("a", 1, 0, 2, 0, 0), ("b", 9, 0, 2, 0, 0), ("c", 9, 0, 3, 0, 1)], "principal string, documents_gained long, documents_lost long, derived_gained long, derived_lost long, by_combination long")
    assert [x.principal for x in policy.most_affected(impacts, 2).collect()] == ["c", "b"] and policy.impact_totals(impacts).first().hidden_ratio == round(7 / 19, 6)


def test_best_documents_are_the_same_either_way(spark):
    import random

    from veilgraph.operators import retrieval

    rng = random.Random(6)
    word = lambda: f"w{min(int(rng.expovariate(0.1)), 60):02}x"
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(300)] + [("dnull", None), ("d300", "w00x"), ("d301", "w00x")], "doc_id string, text string").repartition(5)
    queries = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 8)))) for i in range(25)] + [(99, "unheard")], "query_id long, text string")
    want = sorted(map(tuple, retrieval.ranked(retrieval.bm25(docs, queries), 7).select("query_id", "rank", "doc_id", "score").collect()))
    assert sorted(map(tuple, retrieval.bm25_best(docs, queries, 7).select("query_id", "rank", "doc_id", "score").collect())) == want
    assert sorted(map(tuple, retrieval.bm25_best(docs, queries, 7, most=3).select("query_id", "rank", "doc_id", "score").collect())) == want
    assert retrieval.bm25_best(docs.limit(0), queries, 7).count() == retrieval.bm25_best(docs, queries.limit(0), 7).count() == 0


def test_planner_sweep_plans_every_depth_alone(spark):
    from veilgraph.operators import planner

    rows = [(1, 0, r, f"f{r}", 0, f"e{r // 2 % 2}", "AB"[r % 2], "") for r in range(1, 9)] + [(2, 5, 1, "x", 0, "e9", "A", "")]
    cand = spark.createDataFrame(rows, "principal long, query long, rank int, fact_id string, level int, entity string, space string, claim string")
    secret = spark.createDataFrame([(1, "pair|A|B"), (2, "none")], "principal long, claim string")
    got = {r.k: (r.queries, r.bound, r.suppressed) for r in planner.sweep(cand, secret, (1, 3, 8)).collect()}
    want = {}
    for k in (1, 3, 8):
        kept, dropped, safe = planner.plan([r[3:] for r in rows if r[0] == 1 and r[2] <= k], [], {"pair|A|B"})
        assert safe
        want[k] = (2, int(bool(dropped)), len(dropped))
    assert got == want and want[8][1] == 1


def test_a_reset_within_a_batch_starts_a_new_session(spark, tmp_path):
    from veilgraph.streaming.ledger import plan_stream

    schema = "principal string, rank int, fact_id string, level int, entity string, space string, claim string"
    one = [("p", 0, "f1", 0, "x", "A", "")]
    two = [("p", 0, "f2", 0, "x", "B", ""), ("p", 1, None, None, None, None, None), ("p", 2, "f3", 0, "x", "B", "")]
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = plan_stream(stream, lambda principal: {"person:x"}).writeStream.format("memory").queryName("reset_ledger").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.fact_id: (r.query, r.disclosed) for r in spark.table("reset_ledger").collect()}
    assert got == {"f1": (1, True), "f2": (2, False), "f3": (1, True)}
