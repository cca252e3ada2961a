"""Registered queries cover every principal."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_grants_are_simulated_for_every_principal(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = entry.oracle_sql()["grant_simulation"]
    got = entry.queries()["grant_simulation"](spark, SF).toPandas()
    want = con.execute(sql.replace(" WHERE p.principal % 10 = 0", "")).df()
    assert len(got) > 0 and got["principal"].nunique() == want["principal"].nunique() and (got["principal"] % 10 != 0).any()
    assert rows(got) == rows(want)
    as_is = con.execute(sql).df()  # for those principals whom the registered SQL covers
    assert rows(got[got["principal"].isin(as_is["principal"])]) == rows(as_is)


def test_plans_cover_every_principal_and_fact(spark):
    from veilgraph.plans import texts

    where = "/root/testdata/sf0.01"
    if not os.path.isdir(where):
        pytest.skip("no test tables")
    case = texts.Case(texts.world(spark, where))
    want = {(r.principal, r["count"]) for r in case.w.facts0.join(case.permitted, "space").groupBy("principal").count().collect()}
    plans = entry.queries()["session_ledger"](spark, where).toPandas()
    assert set(plans.groupby("principal")["n_admissible"].sum().items()) == want and plans["n_admissible"].max() <= 12


def test_ledger_plans_as_the_closure_does():
    import random

    from veilgraph.operators import planner

    def slow(candidates, prior, protected):
        kept, dropped = list(candidates), []
        while (bad := planner.closure(prior + kept) & protected) and kept:
            less = [i for i in range(len(kept)) if len(planner.closure(prior + kept[:i] + kept[i + 1 :]) & protected) < len(bad)]
            dropped.append(kept.pop(less[-1] if less else len(kept) - 1))
        return kept, dropped, not bad

    rng = random.Random(2)
    for _ in range(150):
        facts = [(f"f{i}", rng.choice([0, 0, 0, 1]), rng.randrange(7), rng.choice("abcdefghi"), f"s{rng.randrange(5)}") for i in range(60)]
        every = sorted(planner.closure(facts))
        protected = set(rng.sample(every, rng.randint(0, min(len(every), 25))))
        ledger, prior = planner.Ledger(protected), facts[:4] if rng.random() < 0.3 else []
        ledger.add(prior)
        for at in range(4, 60, 8):
            got, want = planner.plan(facts[at : at + 8], ledger, protected), slow(facts[at : at + 8], prior, protected)
            assert got == want == planner.plan(facts[at : at + 8], prior, protected)
            ledger.add(got[0])
            prior = prior + got[0]
