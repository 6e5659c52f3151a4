"""The backoff automaton and distributed counts against a direct computation."""

import math
import random
from collections import Counter

import pytest

from siftwood.llm import lm


def direct(rows, mu, discount):
    docs = [(i, held, [*(t or "").encode().lower().split(), None]) for i, t, held in rows]
    words, pairs, triples, after, starts = Counter(), Counter(), Counter(), {}, 0
    for _, held, w in docs:
        if not held:
            words.update(w)
            h = ["<s>", *w]
            pairs.update(zip(h, w, strict=False))
            triples.update(zip(h, w, w[1:], strict=False))
            for u, v, x in zip(h, w, w[1:], strict=False):
                after.setdefault((u, v), set()).add(x)
            starts += 1
    n, v = sum(words.values()), len(words)
    p1 = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda h, w: (pairs[h, w] + mu * p1(w)) / ((starts if h == "<s>" else words[h]) + mu)

    def p3(u, h, w):
        c = pairs[u, h]
        return (max(triples[u, h, w] - discount, 0) + discount * len(after[u, h]) * p2(h, w)) / c if c else p2(h, w)

    out = []
    for i, held, w in docs:
        base = sum(math.log10(p1(x)) for x in w)
        score = math.log10(p2("<s>", w[0])) + sum(math.log10(p3(*x)) for x in zip(["<s>", *w], w, w[1:], strict=False))
        out.append((i, held, len(w), sum(words[x] > 0 for x in w), n, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,lane", [(50, 3), (1_000_000, 512), (1_000_000, 1)])
def test_equals_direct_counts(spark, monkeypatch, block, lane):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "LANE", lane)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "the", "of", "é", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(0, 40))), i % 5 == 1) for i in range(80)]
    rows += [(100, None, False), (101, "", True), (102, "new words ONLY", True), (103, "\x0bthe\x0c of\n", False), (103, "\x0bthe\x0c of\n", False), (None, "the", False)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, held_out boolean, score double").repartition(3)
    got = sorted((tuple(r) for r in lm.score_texts(df).collect()), key=str)
    for a, b in zip(got, direct(rows, lm.MU, lm.DISCOUNT), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    row = lm.score_texts(df).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert lm.score_texts(df.filter("false")).collect() == []


def test_repeats_score_above_single_texts(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(80))
    twice, once = [text() for _ in range(30)], [text() for _ in range(200)]
    rows = [(i, t, False) for i, t in enumerate(twice + twice + once)]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    cut = sorted((got[i] for i in range(60, 260)), reverse=True)[20]
    assert sum(got[i] > cut for i in range(60)) >= 55
