"""Near-duplicate vectors against brute force."""

import numpy as np

from siftwood.llm import embeddings as em


def brute(rows, cosine=0.9):
    good = {i: np.array(v, float) for i, v in rows if v is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    ids = sorted(i for i, _ in rows)
    near = {i: set() for i in ids}
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= cosine:
                near[i].add(j)
                near[j].add(i)
    label = {i: i for i in ids}
    for _ in ids:
        label = {i: min([label[i], *(label[j] for j in near[i])]) for i in ids}
    return {i: (len(near[i]), label[i], label[i] == i) for i in ids}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(em, "BLOCK", 8)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((30, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    for i in range(90):
        x = base[3] if i % 3 == 0 else base[rng.integers(30)]
        rows.append((100 + i, (rng.uniform(0.5, 20) * (x + rng.standard_normal(16) * 0.03)).tolist()))
    rows += [(300 + i, base[5].tolist()) for i in range(4)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None]), (404, [float("inf")] * 16), (405, []), (406, [1.0]), (407, [3.0]), (408, [-3.0])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<float>, kept string").repartition(3)
    df32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in em.near_vectors(df, recall=0.9999).collect()}
    assert got == brute(df32)


def test_plan_keeps_recall_and_crowd():
    for n in (10, 10_000, 10**9):
        k, tables = em.plan(n)
        near, far = em.agreement(np.sqrt(0.2)), em.agreement(np.sqrt(2))
        assert 1 - (1 - near**k) ** tables >= em.RECALL and n * far**k <= em.CROWD * 1.01


def test_agreement_matches_simulation():
    rng = np.random.default_rng(1)
    for d in (0.3, 1.0):
        a, shift = rng.standard_normal(200_000), rng.uniform(0, em.WIDTH, 200_000)
        same = np.floor((a * d + shift) / em.WIDTH) == np.floor(shift / em.WIDTH)
        assert abs(same.mean() - em.agreement(d)) < 0.005


def test_empty_table(spark):
    assert em.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_of_the_default_just_above_the_least_cosine(spark):
    rng = np.random.default_rng(4)
    n, dim = 3000, 64
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((n, dim))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.92, (n, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([base, c * base + np.sqrt(1 - c * c) * other]))]
    got = {r.vec_id: r for r in em.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[n + i].component_id == i and got[i].n_links == 1 for i in range(n))
    print("recall", found / n)
    assert found >= 0.96 * n and sum(r.n_links for r in got.values()) <= 2 * n


def test_links_close_to_the_least_cosine_are_exact(spark):
    rng = np.random.default_rng(9)
    c = np.linspace(0.895, 0.905, 400)
    rows = []
    for i, x in enumerate(c):
        a, b = rng.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (x * a + np.sqrt(1 - x * x) * b).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in em.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999).collect()}
    assert got == brute(rows)
