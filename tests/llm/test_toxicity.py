"""Toxicity: the index is exact, the score follows the labels."""

import numpy as np

from veilgraph.llm import toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 6), replace=False)).astype(np.int64)
        w = rng.random(len(t)) + 0.01
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.Index.build(vectors, rng.integers(0, 2, 700), np.arange(700), 60)
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        c, rows = index.nearest(*vectors[i], 10, skip=i)
        every = dense @ dense[i]
        every[i] = 0
        assert np.allclose(c, np.sort(every)[::-1][: len(c)])
        assert len(c) == min(10, (every > 0).sum())


def test_pools_are_monotone():
    ends, rates = toxicity.monotone(np.array([0.1, 0.2, 0.2, 0.9]), np.array([1, 0, 0, 1]), np.ones(4))
    assert (np.diff(rates) >= 0).all() and ends[-1] == 0.9


def test_scores(spark, docs_of):
    rows = [(i, f"plain number{i} words " + ("you stupidoaf " if i % 3 == 0 else "") + "end") for i in range(150)] + [(900, None), (901, ""), (902, "STUPIDOAF again"), (902, "calm")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.op1(docs_of(rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in found if r.doc_id < 900)
    assert sorted(r.predicted for r in found if r.doc_id >= 900) == [0, 0, 0, 1]


def test_no_labels_and_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.op1(docs_of([(1, "x")]), none).collect()] == [0.0]
    assert toxicity.op1(docs_of([]), none).count() == 0


def test_examples_are_distinct_texts(spark, docs_of):
    rows = [(i, "one copied rude text") for i in range(400)] + [(1000 + i, f"rude text {i}") for i in range(4)] + [(2000 + i, f"calm text {i}") for i in range(3)]
    kept = [r[0] for r in rows]
    labels = spark.createDataFrame([(i, 1, int(i < 2000)) for i in kept], "doc_id long, quality int, toxic int")
    found = [(r.label, r.text) for r in toxicity.labelled(docs_of(rows), labels, per_class=5)[0].collect()]
    import zlib

    used = [(int(i < 2000), t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(found) == len(set(found)) and set(found) == set(used)


def brute_scores(rows, labels, k):
    """Scores by dictionaries and dense cosines: what op1 says it computes, the slow way."""
    import math
    import re
    import zlib

    terms = lambda t: [w[: toxicity.PREFIX] for x in (t or "").split() for w in re.findall(r"[^\W_]+", x.lower())]
    known = {}
    for i, _, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(y, known.get(i, 0))
    behind = [sum(1 for y in known.values() if y == c) for c in (0, 1)]
    examples = sorted({(known[i], t or ""): i for i, t in sorted(rows, reverse=True) if i in known}.items(), key=lambda e: e[1])
    ys, texts, ids = [e[0][0] for e in examples], [e[0][1] for e in examples], [e[1] for e in examples]
    n = [ys.count(0), ys.count(1)]
    df = {}
    for _, t in rows:
        for x in set(terms(t)):
            df[x] = df.get(x, 0) + 1
    has = {}
    for y, t in zip(ys, texts):
        for x in set(terms(t)):
            has.setdefault(x, [0, 0])[y] += 1

    def worth(x):
        rate, g2 = sum(has[x]) / sum(n), 0.0
        for c in (0, 1):
            for seen, expected in ((has[x][c], rate * n[c]), (n[c] - has[x][c], (1 - rate) * n[c])):
                g2 += 2 * seen * math.log(seen / expected) if seen else 0.0
        return (math.log((len(rows) + 1) / (df[x] + 1)) + 1) * (toxicity.FLOOR + min(max(g2, 0) / toxicity.SURE, 1.0) ** 2)

    def vector(t):
        tf = {}
        for x in terms(t):
            if x in has:
                tf[x] = tf.get(x, 0) + 1
        v = {x: (1 + math.log(c)) * worth(x) for x, c in tf.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()}

    vectors = [vector(t) for t in texts]
    strongest = lambda v: max(v.values(), default=0)
    assert all(strongest(v) > 0 for v in vectors)
    each = [behind[c] / n[c] for c in (0, 1)]
    votes = [e / max(each) for e in each]

    def share(v, skip=None):
        c = sorted(((sum(w * e.get(x, 0.0) for x, w in v.items()), j) for j, e in enumerate(vectors) if j != skip), reverse=True)
        near = [(min(x, 1.0), j) for x, j in c if x > 0][:k]
        w = [(votes[ys[j]] * x * x / (1 + toxicity.EPS - x), ys[j]) for x, j in near]
        return (sum(a for a, y in w if y) / (sum(a for a, _ in w) + toxicity.DOUBT * votes[1])) if near else None

    own = [share(v, j) for j, v in enumerate(vectors)]
    kept = [j for j, s in enumerate(own) if s is not None]
    ends, rates = toxicity.monotone(np.array([own[j] for j in kept]), np.array([ys[j] for j in kept]), np.array([each[ys[j]] for j in kept]))

    def score(t):
        s = share(vector(t))
        if s is None:
            return behind[1] / sum(behind)
        at = min(int(np.searchsorted(ends, s)), len(rates) - 1)
        lo, hi = (rates[at - 1], rates[at]) if at else (rates[0], rates[0])
        return float(np.clip(hi - 1e-3 * (1 - s), min(lo, hi), hi))

    return [score(t) for _, t in rows]


def test_scores_match_brute_force(spark, docs_of):
    import random

    rng = random.Random(5)
    vocab = [f"{chr(97 + i % 26)}{chr(98 + i % 24)}word{i}" for i in range(60)]
    rude = ["rotter!", "(STINKER)", "oafish-loutish"]
    rows, labels = [], []
    for i in range(90):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 12))]
        bad = i % 3 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(500, None), (501, ""), (502, "!!!"), (503, "unknownword"), (504, " ".join(vocab * 40)), (504, rows[0][1]), (505, rows[0][1])]
    found = toxicity.op1(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.count() == len(rows)
    want = {}
    for (i, t), s in zip(rows, brute_scores(rows, labels, toxicity.NEIGHBOURS)):
        want.setdefault(i, []).append(s)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert all(np.allclose(sorted(got[i]), sorted(want[i]), atol=1e-6) for i in want)
    by_text = {t: {round(s, 12) for i, u in rows if u == t for s in got[i] if i != 504} for _, t in rows}
    assert len(by_text[rows[0][1]]) == 1  # equal texts have equal scores


def test_every_text_that_shares_a_term_has_evidence(spark, docs_of):
    rows = [(i, f"common words here {'rude' if i % 2 else 'calm'} {i}") for i in range(60)] + [(100, "here"), (101, "nothing known")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.vg_evidence for r in toxicity.score(docs_of(rows), labels).collect()}
    assert all(found[i] for i in range(60)) and found[100] and not found[101]


def test_names_that_clash_and_long_texts(spark, docs_of):
    import pytest
    from pyspark.sql import functions as F

    rows = [(i, f"plain {i} words " + ("vile" if i % 2 else "kind")) for i in range(40)] + [(77, "kind " * 400_000), (78, "vile words")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows).withColumn("vg_terms", F.lit(1)).withColumn("vg_text", F.lit("x")).withColumn("vg_score", F.lit(2))
    left = toxicity.keep_harmless(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in range(0, 40, 2)} | {77}
    with pytest.raises(ValueError, match="vg_score"):
        toxicity.score(docs, labels)
