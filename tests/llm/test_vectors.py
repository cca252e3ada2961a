"""Embedding near-duplicates against brute force."""

import numpy as np

from veilgraph.llm import vectors


def brute(rows, limit=0.95):
    units = {}
    for i, (vid, v) in enumerate(rows):
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        units[i] = np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64)) if ok else None
    links = {i: set() for i in units}
    for i in units:
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= limit:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in units:
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            low = min(rows[j][0] for j in seen)
            comp |= {j: low for j in seen}
    return {rows[i][0]: (len(links[i]), comp[i], comp[i] == rows[i][0]) for i in units}


def test_links_and_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(300)]
    for g in range(8):
        base = rng.standard_normal(16)
        rows += [(1000 + 100 * g + k, [float(x) for x in base + 0.12 * rng.standard_normal(16)]) for k in range(12)]
    rows += [(5000 + i, rows[310][1]) for i in range(70)]  # one very common vector
    rows += [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [1.0, None]), (6004, []), (6005, [1.0, 2.0]), (6006, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.op9(df).collect()}
    want = brute(rows)
    assert len(found) == len(rows)
    assert all(found[i] == want[i] for i in range(5000, 6007) if i in want)
    linked = [i for i in want if want[i][0]]
    assert sum(found[i] == want[i] for i in linked) >= 0.9 * len(linked)
    assert all(found[i] == want[i] for i in want if not want[i][0])


def test_empty_table(spark):
    assert vectors.op9(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_dense_region_is_exact(spark):
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    core = unit(rng.standard_normal(64))
    hot = np.sqrt(0.8) * core + np.sqrt(0.2) * unit(rng.standard_normal((3000, 64)))  # mutual cosine about 0.8
    twins = unit(hot[:400]) + 0.25 * unit(rng.standard_normal((400, 64)))
    m = unit(np.concatenate([hot, twins, rng.standard_normal((200, 64))]))
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.any(axis=1).sum() >= 800
    least = np.arange(len(m))
    while ((new := np.minimum(least, np.where(near, least, len(m)).min(axis=1))) != least).any():
        least = new
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    for block in (700, vectors.BLOCK):
        found = {r.vec_id: r for r in vectors.near_duplicates(df, block=block).collect()}
        assert [found[i].n_links for i in range(len(m))] == near.sum(axis=1).tolist()
        assert [found[i].component_id for i in range(len(m))] == least.tolist()


def test_plans_reach_the_recall():
    import math

    rng = np.random.default_rng(9)
    sample = list(rng.standard_normal((400, 16)))
    agree, before = 1 - math.acos(0.95) / math.pi, -1
    for n in (10, 10**4, 10**6, 10**9):
        bits, passes = vectors.plan(n, sample, 0.95)
        assert (1 - agree**bits) ** passes <= 1 - vectors.RECALL + 1e-12 and bits >= before
        before = bits
    assert vectors.plan(10, sample, 0.95) == (0, 1) and before > 4
    assert vectors.plan(10**4, [sample[0]] * 300, 0.95) == (0, 1)  # hashes cannot part equal directions


def test_planted_pairs_are_found_in_passes(spark):
    rng = np.random.default_rng(10)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    for number, parts, dim in ((3000, 1, 64), (9000, 5, 64), (3000, 7, 24)):
        base = unit(rng.standard_normal((number, dim)))
        side = rng.standard_normal((600, dim))
        side = unit(side - (side * base[:600]).sum(1, keepdims=True) * base[:600])
        m = np.concatenate([base, 0.951 * base[:600] + np.sqrt(1 - 0.951**2) * side])
        near = unit(m) @ unit(m).T >= 0.95
        np.fill_diagonal(near, False)
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(parts)
        sample = list(unit(m)[:1000])
        bits, passes = vectors.plan(len(m), sample, 0.95, move=20)
        assert bits >= 4 and passes > vectors.TOGETHER
        got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, move=20).collect()}
        want = near.sum(axis=1)
        assert all(got[i] <= want[i] for i in range(len(m)))  # none is false, none counts twice
        assert sum(got.values()) >= 0.99 * want.sum()


def test_links_hang_on_no_size(spark):
    """Pairs just above the limit, alone and among others: the same links, all of them."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base, side = unit(rng.standard_normal((4500, 48))), rng.standard_normal((4500, 48))
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    pairs = np.concatenate([base, 0.9501 * base + np.sqrt(1 - 0.9501**2) * side])
    for m in (pairs, np.concatenate([pairs, unit(rng.standard_normal((7000, 48)))])):
        want = np.concatenate([(unit(m[i : i + 1000]) @ unit(m).T >= 0.95).sum(axis=1) - 1 for i in range(0, len(m), 1000)])
        assert (want[:9000] == 1).all() and not want[9000:].any()
        df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>")
        found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.op9(df).collect()}
        assert found == {i: (int(want[i]), i - 4500 if 4500 <= i < 9000 else i) for i in range(len(m))}


def test_a_caller_may_choose_passes(spark):
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((2500, 32)))
    m = unit(np.concatenate([base, base[:500] + 0.28 * unit(rng.standard_normal((500, 32)))]))
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    bits, passes = vectors.plan(len(m), list(m[:1000]), 0.95, move=20)
    assert bits >= 4 and passes > vectors.TOGETHER
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, recall=vectors.RECALL, move=20).collect()}
    want = near.sum(axis=1)
    assert want.sum() >= 1000 and all(got[i] <= want[i] for i in range(len(m)))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_looks_lose_no_pair():
    rng = np.random.default_rng(13)
    for dim in (2, 16, 17, 64, 200, 1024):
        x = rng.standard_normal((2500, dim))
        x[:300] = x[300:600] + 0.3 * rng.standard_normal((300, dim))
        x[600:700] = x[700] + 0.2 * rng.standard_normal((100, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        times = rng.integers(1, 4, len(x))
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        assert (vectors._links(x, None, times, None, 0.95)[0] == near @ times).all()
        a, b = slice(0, 1100), slice(1100, None)
        across = vectors._links(x[a], x[b], times[a], times[b], 0.95)[0]
        assert (across == np.concatenate([near[a, b] @ times[b], near[b, a] @ times[a]])).all()
