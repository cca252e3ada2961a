"""N-gram Jaccard join and components against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilgraph.llm import jaccard
from veilgraph.llm.components import components


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = tuple((t or "").encode().lower().split())
        sets.append({w[i : i + width] for i in range(max(len(w) - width + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[b] = a
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def texts(seed, n_groups=6, copies=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    out = [None, "", " \n", "one", "ONE", "one two", "a b c", "A B C d"]
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w) + (" " + passage if rng.random() < 0.2 else ""))
    out += out[10:14]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_components_match_brute_force(docs_of, width, percent, seed):
    rows = texts(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(rows), width, percent).collect()}
    assert found == brute(rows, width, percent)


def test_keep_one(docs_of):
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([(3, long), (1, long + " x"), (2, "other words here"), (5, None), (None, long), (7, ""), (7, "")]).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 5, 7, 7]


def test_empty_table(docs_of):
    assert jaccard.op6(docs_of([])).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
def test_connected_components(spark, edges):
    edges = edges + [(100 + i, 101 + i) for i in range(12)]  # a path
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_names_of_sets_that_share_half_a_digest(docs_of, monkeypatch):
    whole = jaccard.digest
    monkeypatch.setattr(jaccard, "digest", lambda found: b"\0" * 8 + whole(found)[8:])  # all first halves are alike
    rows = texts(4, n_groups=2, copies=4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(rows), 3, 90).collect()}
    assert found == brute(rows, 3, 90)


def test_long_texts(docs_of):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, " ".join(f"v{i}" for i in range(200_000))), (4, "short")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op6(docs_of(rows)).collect()}
    assert found == {1: (199_998, 1), 2: (199_999, 1), 3: (199_998, 3), 4: (1, 4)}


def test_keep_one_beside_a_clashing_name(docs_of):
    from pyspark.sql import functions as F

    left = jaccard.keep_one(docs_of([(1, "a b c d e f"), (2, "a b c d e f")]).withColumn("vg_gone", F.lit(1)))
    assert [(r.doc_id, r.vg_gone) for r in left.collect()] == [(1, 1)]
