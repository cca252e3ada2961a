"""Operators on small hand-made and generated worlds."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veilgraph.operators import adversary, audit, contest, derivation, mentions, permissions, planner, policy, provenance
from veilgraph.sources import corpus


def test_inheritance_and_cycles(spark):
    member = spark.createDataFrame([("e1", "Alpha"), ("e2", "Beta"), ("e3", "Alpha"), ("e3", "Beta")], "principal string, space string")
    manages = spark.createDataFrame([("e4", "e1"), ("e1", "e4"), ("e5", "e4")], "manager string, report string")
    got = {(r.principal, r.space) for r in permissions.permitted(member, manages).collect()}
    assert {("e4", "Alpha"), ("e5", "Alpha"), ("e3", "Beta")} <= got and ("e4", "Beta") not in got and ("e5", "Beta") not in got


def test_admissible_fails_closed(spark):
    rows = spark.sql("""SELECT * FROM VALUES (array('a','b'), array('a')), (array('a'), array('a','b')), (array('a'), cast(array() as array<string>)), (cast(null as array<string>), cast(array() as array<string>)) AS t(perm, req)""")
    got = rows.select(permissions.admissible(F.col("perm"), F.col("req")).alias("a"), permissions.decision(F.col("perm"), F.col("req")).alias("d")).collect()
    assert [r.a for r in got] == [True, False, True, False] and [r.d for r in got] == [True, False, False, False]


def test_required_spaces_meet_the_sentinel(spark):
    facts0 = spark.createDataFrame([("s1", "A"), ("s2", "B")], "fact_id string, space string")
    edges = spark.createDataFrame([("d1", "s1"), ("d1", "s2"), ("d2", "d1"), ("d3", "d2"), ("d3", "gone"), ("d4", "d3")], "fact_id string, support_id string")
    req = {}
    for r in provenance.required_by_walk(edges, facts0).collect():
        req.setdefault(r.fact_id, set()).add(r.space)
    assert req["d2"] == {"A", "B"} and req["d4"] == {"A", "B", provenance.UNRESOLVABLE}
    short = {(r.fact_id, r.space) for r in provenance.required_by_walk(edges, facts0, most_rounds=2).collect()}
    assert ("d4", provenance.UNRESOLVABLE) in short


def world(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for e in range(4):
        for s in range(4):
            for _ in range(rng.randint(0, 2)):
                rows.append((f"f{n:03}", f"e{e}", f"s{s}", n))
                n += 1
    return rows, spark.createDataFrame(rows, "fact_id string, entity string, space string, ord int")


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_cuts_against_brute_force(spark, seed):
    rows, facts0 = world(spark, seed)
    tuples = [(f, 0, e, s, "") for f, e, s, _ in rows]
    claims = planner.closure(tuples)
    seen = facts0.withColumn("principal", F.lit("p"))
    assert {r.claim for r in adversary.rebuilt_claims(seen).collect()} == claims
    cuts = {(r.a, r.b): r.cost for r in adversary.pair_cuts(adversary.span_costs(seen)).collect()}
    pairs = sorted(c for c in claims if c.startswith("pair"))[:2]
    for c in pairs:
        a, b = c.split("|")[1:]
        relevant = [t for t in tuples if t[3] in (a, b)]
        best = next(k for k in range(len(relevant) + 1) for gone in combinations(relevant, k) if c not in planner.closure([t for t in tuples if t not in gone]))
        assert cuts[a, b] == best
    held = adversary.cuts_hold(seen, adversary.reconstruct(seen)["pair"].select("principal", "a", "b")).collect()
    assert held and all(r.holds for r in held)


def test_planner_never_leaks():
    rng = random.Random(4)
    for _ in range(60):
        facts = [(f"f{i}", 0, f"e{rng.randrange(4)}", f"s{rng.randrange(4)}", "") for i in range(rng.randint(1, 12))]
        every = sorted(planner.closure(facts))
        secret = set(rng.sample(every, min(len(every), 2)))
        kept, dropped, safe = planner.plan(facts, [], secret)
        assert safe and not planner.closure(kept) & secret and len(kept) + len(dropped) == len(facts)
        assert dropped or not planner.closure(facts) & secret
    prior = [("a", 0, "x", "s1", ""), ("b", 0, "x", "s2", "")]
    assert planner.plan([("c", 0, "y", "s1", "")], prior, {"person:x"}) == ([], [("c", 0, "y", "s1", "")], False)


def test_policy_preview_recounts(spark):
    facts0 = spark.createDataFrame([("f1", "A"), ("f2", "B"), ("f3", "B")], "fact_id string, space string")
    facts = spark.createDataFrame([("d", ["A", "B"]), ("g", ["B"])], "fact_id string, req array<string>")
    before = spark.createDataFrame([("p", "A")], "principal string, space string")
    after = policy.compile_policy(policy.grant(before.toDF("subject", "space"), spark.createDataFrame([("p", "B")], "subject string, space string")), None)
    r = policy.preview(before, after, facts0, facts).collect()
    assert [tuple(x) for x in r] == [("p", 1, 0, 2, 0, 2, 0, 1)]
    assert policy.changes(before, before).count() == 0


def log(spark):
    rows = [("c", i, f"2024-01-01T00:00:{i:02}", "disclose", "p é", ["f2", "f1"], None if i % 2 else '{"k":1}') for i in range(8)]
    return audit.record(spark.createDataFrame(rows, "chain string, seq long, at string, decision string, principal string, facts array<string>, detail string"))


def test_audit_finds_tampering(spark):
    good = log(spark)
    rows = sorted((r.asDict() for r in good.collect()), key=lambda r: r["seq"])
    check = lambda x: audit.verify(spark.createDataFrame(x, good.schema)).collect()[0]
    assert check(rows).broken_at is None and check(rows).entries == 8
    edited = [dict(r, decision="refuse") if r["seq"] == 5 else r for r in rows]
    assert (check(edited).broken_at, check(edited).reason) == (5, "modified")
    assert check([r for r in rows if r["seq"] != 3]).broken_at == 3
    swapped = [dict(r, seq={2: 3, 3: 2}.get(r["seq"], r["seq"])) for r in rows]
    assert check(swapped).broken_at == 2


def test_audit_refuses_content(spark):
    rows = spark.sql("SELECT map('Text', 'secret') AS detail_map")
    with pytest.raises(Exception, match="content field"):
        audit.refuse_content(rows).collect()


def test_contest(spark):
    text = "The Billing migration is blocked. RiverPlan was approved. RiverPlan ships in March 3."
    other = "the billing migration is completed. RiverPlan was Rejected."
    src = spark.createDataFrame([("1", "A", text), ("2", "B", other)], "source_id string, space string, text string")
    claims = contest.extract_claims(src)
    got = {(r.predicate, r.subject): r.cross_space for r in contest.contradictions(claims).collect()}
    assert got == {("status", "the billing migration"): True, ("decision", "riverplan"): True}
    permitted = spark.createDataFrame([("p", "A"), ("q", "B"), ("r", "A"), ("r", "B"), ("z", "C")], "principal string, space string")
    r = contest.disclosure_dependent(claims, permitted).filter("predicate = 'status'").collect()[0]
    assert (r.settled_for, r.sees_nothing, r.opposed) == (2, 1, 1)


def test_mentions_and_resolution(spark):
    staff = spark.createDataFrame([("eid_aaaaa1", "Ann Lee"), ("eid_aaaaa2", "Ann Ray"), ("eid_aaaaa3", "Bo Ray")], "id string, name string")
    src = spark.createDataFrame(
        [
            ("S::1", "S", "slack", None, [], "Ann Lee met Bo. Later Ann spoke with eid_aaaaa2"),
            ("S::2", "S", "document", "eid_aaaaa3", [], "Ann wrote this"),
            ("S::3", "S", "slack", None, [], "Ann said hi"),
            ("T::4", "T", "slack", None, [], "Ann said hi. Emma. Also"),
        ],
        "source_id string, space string, kind string, author string, participants array<string>, text string",
    )
    roster = spark.createDataFrame([("S", "eid_aaaaa1")], "space string, employee_id string")
    m = mentions.extract(src, staff)
    r = {(x.source_id, x.surface): (x.resolved, x.method) for x in mentions.resolve(m, src, staff, roster).join(m, ["source_id", "nth"]).collect()}
    assert r["S::1", "Ann Lee"] == ("eid_aaaaa1", "unique-name") and r["S::1", "Bo"] == ("eid_aaaaa3", "unique-name")
    assert r["S::1", "Ann"] == ("eid_aaaaa2", "co-presence") and r["S::2", "Ann"] == (None, "abstained")
    assert r["S::3", "Ann"] == ("eid_aaaaa1", "space-roster") and r["T::4", "Ann"] == (None, "abstained")


def test_json_sources(spark, tmp_path):
    (tmp_path / "products").mkdir()
    (tmp_path / "employee.json").write_text(json.dumps({"eid_a1": {"name": "Ann", "role": "x", "location": "y", "org": "z"}}))
    (tmp_path / "salesforce_team.json").write_text(json.dumps([{"employee_id": "m", "reports": [{"employee_id": "r", "more": [{"employee_id": "q"}]}]}]))
    product = {
        "team": ["eid_a1"], "slack": [{"Message": {"User": {"userId": "eid_a1", "text": "hi"}}, "ThreadReplies": [{"User": {"userId": "eid_b2", "text": "yo"}}]}],
        "documents": [{"id": "d1", "content": "text", "author": {"id": "eid_a1"}}, {"id": "d2", "content": " "}], "prs": [{"id": "p", "title": "t", "summary": ""}],
        "answerable_questions": [{"question": "q?", "ground_truth": ["a"], "citations": ["d1"], "type": "people"}], "unanswerable_questions": ["u?", {"question": "v?"}],
    }
    (tmp_path / "products" / "Red.json").write_text(json.dumps(product))
    c = corpus.load(spark, f"file://{tmp_path}")
    got = {r.source_id: (r.kind, r.text, r.author) for r in c.sources.collect()}
    assert got == {"Red::Red-slack-0": ("slack", "hi\nyo", "eid_a1"), "Red::d1": ("document", "text", "eid_a1"), "Red::p": ("pr", "t", None)}
    assert {(r.manager, r.report) for r in c.manages.collect()} == {("m", "r"), ("r", "q")}
    assert {(r.question, r.answerable) for r in c.questions.collect()} == {("q?", True), ("u?", False), ("v?", False)}
    snap = {
        "owner": "o", "repos": [{"name": "pub", "private": False, "collaborators": []}, {"name": "priv", "private": True, "collaborators": ["x"]}],
        "issues": [{"repo": "priv", "number": 1, "title": "t", "body": "b", "author": "x", "comments": []}],
        "teams": [{"slug": "top", "parent": None, "members": [], "repos": ["priv"]}, {"slug": "low", "parent": "top", "members": ["y"], "repos": []}],
    }
    (tmp_path / "snap.json").write_text(json.dumps(snap))
    s = corpus.load_snapshot(spark, f"file://{tmp_path}/snap.json")
    assert {(r.principal, r.space) for r in s.member_of.collect()} == {("o", "pub"), ("o", "priv"), ("x", "priv"), ("x", "pub"), ("y", "priv"), ("y", "pub"), ("public", "pub")}
    assert [r.text for r in s.sources.collect()] == ["t\nb"]


def test_streaming_ledger_only_tightens(spark, tmp_path):
    from veilgraph.streaming.ledger import plan_stream

    schema = "principal string, rank int, fact_id string, level int, entity string, space string, claim string"
    one = [("p", 0, "f1", 0, "x", "A", ""), ("p", 1, "f2", 0, "y", "A", "")]
    two = [("p", 0, "f3", 0, "x", "B", ""), ("p", 1, "f4", 0, "z", "B", "")]
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = plan_stream(stream, lambda principal: {"person:x"}).writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("ledger").collect()
    shown = {r.fact_id for r in got if r.disclosed}
    assert len(got) == 4 and not {"f1", "f3"} <= shown and {"f2", "f4"} <= shown


def test_pairs_cite_the_first_six(spark):
    rows = [(f"f{e}{s}", f"e{e}", s, e * 10 + i) for e in range(9) for i, s in enumerate("AB")]
    person = derivation.person_support(spark.createDataFrame(rows, "fact_id string, entity string, space string, ord int"))
    got = derivation.pair_support(person).collect()
    assert {r.support_id for r in got} == {f"person:e{e}" for e in range(6)} and {r.n_people for r in got} == {9}
