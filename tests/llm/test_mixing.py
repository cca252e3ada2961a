"""Mixing against its SQL and its rules."""

import random

import duckdb
import pandas as pd

from veilgraph.llm import mixing


def rows():
    rng = random.Random(11)
    out = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), f"s{min(int(rng.expovariate(0.5)), 6)}") for i in range(400)]
    return out + [(900, None, None), (901, "a b", None), (902, "", "s0"), (None, "x y z", "s1"), (903, "  \t\n", "zz"), (5, out[5][1], out[5][2])]


def test_same_as_sql(docs_of):
    docs = docs_of(rows())
    found = mixing.op10(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(), columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = con.execute(mixing.ORACLE).df()
    key = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None)[["doc_id", "size", "source_size", "target", "taken"]].astype(str).values.tolist()))
    assert key(found.astype({"doc_id": "Int64"})) == key(want.astype({"doc_id": "Int64"}))
    assert (found.taken <= 2 * found["size"]).all()


def test_mix_repeats_and_reruns(docs_of):
    docs = docs_of(rows())
    a, b = (sorted((r.doc_id or -1) for r in mixing.mix(docs).collect()) for _ in range(2))
    assert a == b and mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs_of([])).count() == 0


def test_own_columns_of_the_same_names_stay(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(i, "a b c", f"s{i % 2}") for i in range(8)])
    for c in ("vg_copies", "vg_i", "vg_size", "vg_rank", "vgp_p"):
        docs = docs.withColumn(c, F.concat(F.lit(c), "doc_id"))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in ("vg_copies", "vg_i", "vg_size", "vg_rank"))
