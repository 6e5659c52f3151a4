"""The Jaccard join against brute force."""

import random

import numpy as np
import pytest

from siftwood.llm import jaccard


def brute(docs, size, num, den):
    sets, parent = {}, {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[i], parent[i] = s, i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [word() for _ in range(40)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.45 or not docs:
            text = " ".join(word() for _ in range(rng.randrange(1, 120)))
        elif kind < 0.6:
            text = " ".join(shared + [word() for _ in range(rng.randrange(0, 8))])
        else:
            w = rng.choice(docs)[1].split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = word()
            text = "  ".join(w).upper() if rng.random() < 0.5 else " ".join(w)
        docs.append((i, text))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "Ünï ÜNÏ"), (n + 6, "x " * 5000)]


@pytest.mark.parametrize("size,num,den,frequent", [(4, 85, 100, 100), (4, 85, 100, 2), (2, 8, 10, 1)])
def test_equals_brute_force(spark, monkeypatch, size, num, den, frequent):
    docs = corpus(seed=frequent)
    monkeypatch.setattr(jaccard, "MEETING", 8)
    monkeypatch.setattr(jaccard, "frequent_tokens", lambda rows, f=jaccard.frequent_tokens: f(rows, least=frequent))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, size, num, den).collect()}
    assert got == brute(docs, size, num, den)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_signatures_miss_no_pair(share):
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 90))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = x.copy()
        drop = int(rng.integers(0, max(1, len(x) // 8) + 1))
        y = np.delete(y, rng.choice(len(y), min(drop, len(y) - 1), replace=False))
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, int(rng.integers(0, 6))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * (len(x) + len(y) - both):
            continue
        every = np.union1d(x, y)
        hot = np.unique((every[rng.random(len(every)) < share] >> np.uint64(32)).astype(np.uint32))
        sign = jaccard.Signatures(85, 100, rng.permutation(hot))
        assert np.array_equal(x, y) or len(np.intersect1d(sign(x), sign(y)))


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    from siftwood.llm import common

    texts = [b"one Two three", None, b"", b" two  THREE\n", b"x" * 70 + b" two " + b"y " * 40]
    plain = [list(h) for h in common.WordHashes().texts(texts)]
    monkeypatch.setattr(common, "PIECE", 16)
    assert [list(h) for h in common.WordHashes().texts(texts)] == plain
    assert plain[0][1:] == plain[3] and plain[1] == plain[2] == [] and plain[4][1] == plain[0][1] and len(plain[4]) == 42


def test_sketches_bound_the_intersection():
    rng = np.random.default_rng(9)
    for n, m in ((10, 12), (500, 450), (3000, 70), (70_000, 60_000)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: min(n, m) // 2], rng.integers(0, 1 << 63, m - min(n, m) // 2).astype(np.uint64)]))
        bound = jaccard.Sketches([jaccard.sketch(x), jaccard.sketch(y), b""]).bound(np.array([0, 0, 2]), np.array([1, 0, 1]))
        assert len(np.intersect1d(x, y)) <= bound[0] <= min(len(x), len(y)) and bound[1] == len(x) and bound[2] > len(x) + len(y)


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == [(False, 3, 3), (False, 7, 3), (False, 7, 3), (True, 0, 3)]


def test_carried_sketches_bound_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n), np.uint64)) for n in rng.integers(1, 1500, 120)]
    sets += [np.unique(np.concatenate([x[: len(x) * 7 // 8], rng.integers(0, 1 << 63, len(x) // 8 + 1, np.uint64)])) for x in sets]
    sets += [np.arange(300, dtype=np.uint64) << np.uint64(20), np.arange(700, dtype=np.uint64) << np.uint64(9)]  # all in one bin, or a few
    rows = [jaccard.carried(jaccard.sketch(x)) for x in sets]
    assert max(map(len, rows)) <= 2 + jaccard.NARROW // 4
    x, y = np.triu_indices(len(sets))
    most = jaccard.Carried(rows).bound(x, y)
    assert all(m >= len(np.intersect1d(sets[i], sets[j])) for i, j, m in zip(x.tolist(), y.tolist(), most.tolist(), strict=True))


def test_sets_below_the_threshold_do_not_leave_a_bucket(spark, tmp_path):
    """400 tokens, of which any two share seven in ten: none of the pairs is a link, and none leaves; those that share more do."""
    rng = np.random.default_rng(6)
    new = lambda n: rng.integers(0, 1 << 62, n, np.uint64)
    core = new(280)
    sets = [np.concatenate([core, new(120)]) for _ in range(40)]
    sets += [np.concatenate([sets[0][:380], new(20)])]
    base = spark.createDataFrame([(i, len(x), 0, bytearray(jaccard.sketch(x))) for i, x in enumerate(sets)], "doc_id long, n int, digest long, sketch binary")
    rows = spark.createDataFrame([(7, i, len(x), i) for i, x in enumerate(sets)], "sig long, id long, n int, part long")
    assert [tuple(r) for r in jaccard.crossing(rows, base, 80, 100, f"file://{tmp_path}/facts").collect()] == [(0, 40)]
