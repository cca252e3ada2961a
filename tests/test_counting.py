"""Counts over sets of spaces and people, against loops over all pairs, and without a row for each pair."""

import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_queries import SF, TABLES, rows
from veilgraph.operators import attack, claims, counting
from veilgraph.operators import permissions as P

#: Queries that count over sets without testing each pair of them.
NO_PAIRS = [
    "admissible_counts",
    "attribution_flips",
    "audience_collapse",
    "dkl_score",
    "false_denials",
    "gate_any_source",
    "gate_document_acl",
    "gate_leaks_by_level",
    "invariant_violations",
    "protected_claims",
    "refusal_mutual_information",
    "risk_surface",
    "theorem1_check",
    "over_restriction",
    "aggregation_census",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_pair_of_sets_is_tested(spark, monkeypatch, name):
    def pair(*_):
        raise AssertionError("a pair of sets is tested")

    for module in (P, attack, claims):
        monkeypatch.setattr(module, "admissible", pair, raising=False)
    monkeypatch.setattr(F, "array_except", pair)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def _world(seed, n=60, names="abcdefgh"):
    rng = random.Random(seed)
    return [sorted(rng.sample(names, rng.randint(0, len(names)))) for _ in range(n)]


def test_holders_are_those_of_a_loop(spark, monkeypatch):
    monkeypatch.setattr(counting, "SETS", 16)
    monkeypatch.setattr(counting, "ASKED", 8)
    sets, asked = [s for s in _world(1) if s] + [["z"]], [*_world(2, 30), [None], ["a", None], ["nobody"]]
    perms = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "principal int, perm array<string>")
    got = counting.holders(spark.createDataFrame([(w,) for w in asked], "want array<string>"), counting.counted_sets(perms)).collect()
    share = lambda w, s: len(set(w) & set(s))
    want = {tuple(w): (sum(share(w, s) == len(w) for s in sets), sum(share(w, s) >= 1 for s in sets), sum(share(w, s) >= 2 for s in sets)) for w in asked}
    assert {tuple(r.want): (r.n_all, r.n_any, r.n_two) for r in got} == want


def test_audiences_of_odd_facts(spark):
    people = [(1, ["a", "b"]), (2, ["b", "c"]), (3, ["a", "b"]), (4, [])]
    facts = [("f1", "a", ["a", "b"]), ("f2", "c", ["b"]), ("f3", None, None), ("f4", "a", []), ("f5", "q", ["q"])]
    perms = spark.createDataFrame(people, "principal int, perm array<string>")
    got = {r.space if r.req is None else ",".join(r.req): r for r in P.audiences(spark.createDataFrame(facts, "fact_id string, space string, req array<string>"), perms).collect()}
    counts = lambda r: (r.ok, r.filed, r.some, r.ok_filed, r.ok_some)
    assert {k: counts(r) for k, r in got.items()} == {"a,b": (2, 2, 3, 2, 2), "b": (3, 1, 3, 1, 3), None: (0, 0, 0, 0, 0), "": (4, 2, 0, 2, 0), "q": (0, 0, 0, 0, 0)}
    assert {r.everyone for r in got.values()} == {4}


def test_namesakes_are_counted_and_not_listed(spark):
    """A name that many share is looked up once, not once for each of them: no window over pools, and the same choices."""
    from veilgraph.operators import mentions

    staff = spark.createDataFrame([(f"eid_{i:06x}", f"Ana L{i}") for i in range(300)], "id string, name string")
    eid = lambda i: f"eid_{i:06x}"
    rows = [(f"d{i}", "s", "document", eid(i), [eid(i)], "then Ana wrote") for i in range(300)] + [("two", "s", "document", eid(1), [eid(2)], "eid_000002 and Ana"), ("team", "t", "document", None, [], "and Ana")]
    src = spark.createDataFrame(rows, "source_id string, space string, kind string, author string, participants array<string>, text string")
    roster = spark.createDataFrame([("t", eid(7)), ("u", eid(8))], "space string, employee_id string")
    found = mentions.extract(src, staff)
    out = mentions.resolve(found, src, staff, roster)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.source_id, r.method): (r.resolved, r.candidates) for r in out.join(found.filter("register = 'first-name'").select("source_id", "nth"), ["source_id", "nth"]).collect()}
    want = {(f"d{i}", "co-presence"): (eid(i), 1) for i in range(300)} | {("two", "proximity"): (eid(1), 2), ("team", "space-roster"): (eid(7), 1)}
    assert got == want


def test_facts_under_sets_and_one_space_short(spark, monkeypatch):
    monkeypatch.setattr(counting, "SETS", 16)
    sets = sorted({tuple(s) for s in _world(3, 40, "abcdef")})
    asked = [(w, i + 1) for i, w in enumerate([*_world(4, 25, "abcdefg"), ["x"], []])]
    names = spark.createDataFrame([(f"s{i}", list(s)) for i, s in enumerate(sets)], "sig string, names array<string>")
    rows_ = spark.createDataFrame(asked, "want array<string>, n long")
    under = {r.sig: r.n for r in counting.covered(names, rows_, "sig").collect()}
    assert all(under.get(f"s{i}", 0) == sum(n for w, n in asked if set(w) <= set(s)) for i, s in enumerate(sets))
    short = {(r.sig, r.name): (r.n, r.n_more) for r in counting.one_short(names, rows_, "sig").collect()}
    for i, s in enumerate(sets):
        for name in "abcdefgx":
            lack = [(w, n) for w, n in asked if set(w) - set(s) == {name}]
            assert short.get((f"s{i}", name), (0, 0)) == (sum(n for _, n in lack), sum(n for w, n in lack if len(w) > 1))


def test_what_readers_settle_for_is_that_of_a_loop(spark):
    import random

    from veilgraph.operators import contest

    rng = random.Random(5)
    claims = [("status", s, rng.choice("xyz"), rng.choice("abcdef"), i) for i, s in enumerate(rng.choices(range(12), k=90))]
    held = {p: set(rng.sample("abcdefg", rng.randint(1, 4))) for p in range(25)}
    rows_ = spark.createDataFrame(claims, "predicate string, subject int, value string, space string, ord int")
    perm = spark.createDataFrame([(p, s) for p, ss in held.items() for s in ss], "principal int, space string")
    want, told = {}, {}
    for subject in {c[1] for c in claims}:
        sides = {v: {c[3] for c in claims if c[1:3] == (subject, v)} for v in {c[2] for c in claims if c[1] == subject}}
        if len(sides) < 2:
            continue
        seen = {p: [v for v in sides if sides[v] & ss] for p, ss in held.items()}
        one = [v[0] for v in seen.values() if len(v) == 1]
        want[subject] = (len(one), sum(not v for v in seen.values()), sum(a != b for i, a in enumerate(one) for b in one[:i]))
        told |= {(subject, p): len(sides) - len(v) for p, v in seen.items() if 0 < len(v) < len(sides)}
    got = contest.disclosure_dependent(rows_, perm)
    assert {r.subject: (r.settled_for, r.sees_nothing, r.opposed) for r in got.collect()} == want
    notices = contest.notice(rows_, perm)
    assert {(r.subject, r.principal): int(r.notice.split(" ")[0]) for r in notices.collect()} == told
