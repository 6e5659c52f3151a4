"""The FM-index and decontamination against plain search."""

import random

import numpy as np
import pytest

from siftwood.llm import decontaminate as dc


def test_index_counts_and_locates():
    rng = np.random.default_rng(2)
    for top in (1, 3, 40):
        s = rng.integers(1, top + 1, 500)
        index = dc.FMIndex(s, sample=7)
        table = np.array([[*s[i : i + 4]] for i in (0, 100, 496)] + [[top + 1] * 4])
        lo, hi = index.search(table, np.full(4, 4))
        for k, p in enumerate(table):
            want = [i for i in range(len(s) - 3) if (s[i : i + 4] == p).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def brute(text, items, window=10):
    words = dc.words_of(text.encode() if text else None)
    hit, own = set(), set()
    for item, t in items:
        w = dc.words_of(t.encode() if t else None)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    own.add(item)
    return len(words), len(hit), sorted(own)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_equals_plain_search(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(dc, "SHARD_DOCS", 20)
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "Éa 9"), (54, "Éa-9")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = rng.choice(items[:12])[1].upper().split()
        docs.append((i, ", ".join(w)))
    docs += [(90, None), (91, ""), (92, "éa 9 Éa_9"), (93, " v1")]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_hit int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in dc.contamination(df, bench, block_bytes=block_bytes).collect()}
    assert got == {i: brute(t, items) for i, t in docs}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dc.contamination(docs, none).collect()] == [(2, 0)]
    assert dc.contamination(docs.filter("false"), none).collect() == []


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_items_without_id_hit(spark, block_bytes):
    bench = spark.createDataFrame([(None, "one two"), (None, "six seven"), (3, "one two"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two y"), (2, "six seven"), (3, "none")], "doc_id long, text string")
    out = dc.contamination(docs, bench, block_bytes=block_bytes)
    assert {r.doc_id: (r.n_hit, list(r["items"])) for r in out.collect()} == {1: (2, [3, None]), 2: (2, [None]), 3: (0, [])}


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_repeated_and_null_ids_in_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(dc, "SHARD_WORDS", 40)
    bench = spark.createDataFrame([(i, " ".join(f"b{i}w{k}" for k in range(12))) for i in range(6)], "item_id long, text string")
    item = lambda i, n=12: " ".join(f"b{i}w{k}" for k in range(n))
    rows = [(1, f"x {item(0)} y {item(3)}"), (1, item(1, 9)), (1, f"x {item(0)} y {item(3)}"), (None, item(2)), (None, "clean"), (7, f"{item(4)} {item(4)} " * 50)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), [tuple(s) for s in r.spans]) for r in dc.contamination(docs, bench, block_bytes=block_bytes).collect())
    assert got == sorted([("1", 26, 24, [0, 3], [(1, 13), (14, 26)]), ("1", 26, 24, [0, 3], [(1, 13), (14, 26)]), ("1", 9, 0, [], []), ("None", 12, 12, [2], [(0, 12)]), ("None", 1, 0, [], []), ("7", 1200, 1200, [4], [(0, 1200)])])
