"""Poisson replication."""

import hashlib
import math

from siftwood.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy_no string"


def expected(doc_id, rate, seed=17):
    draws, total = max(1, math.ceil(rate / mixing.CHUNK)), 0
    for j in range(1, draws + 1):
        u = (int(hashlib.md5(f"{seed}:{doc_id}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-rate / draws)
        k = 0
        while c < u and k < 160:
            k += 1
            p *= rate / draws / k
            c += p
            total += 1
    return total


def test_counts_follow_the_inverse_distribution(spark):
    rows = [(i, "x" * (1 + i % 7), "big" if i % 3 else "small", "old") for i in range(600)] + [(1000, None, None, "old"), (1001, "", "empty", "old")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    weights = {"big": 1.0, "small": 60.0}
    rates = {r.source_key: r.rate for r in mixing.repetition_rates(df, weights, budget=3.0).collect()}
    units = {s: sum(len(t or "") for _, t, x, _ in rows if x == s) for s in ("big", "small")}
    total = sum(units.values())
    assert abs(rates["small"] - 60 / 61 * 3 * total / units["small"]) < 1e-9 and rates["empty"] == 1.0 and rates[mixing.NO_SOURCE] == 1.0
    out = mixing.poisson_mix(df, weights, budget=3.0).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.copy_no)
    for i, _, s, _ in rows:
        assert sorted(got.get(i, [])) == list(range(1, expected(i, rates[mixing.NO_SOURCE if s is None else s]) + 1))
    share = sum(len(r.text or "") for r in out if r.source == "small") / sum(len(r.text or "") for r in out)
    assert abs(share - 60 / 61) < 0.02


def test_large_means_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "abc", "s", ""), (5, "abc", "s", ""), (None, "abc", "s", "")], SCHEMA)
    out = mixing.poisson_mix(df, {"s": 1.0}, budget=100.0).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {5: 2 * expected(5, 100.0), None: expected("null", 100.0)}
    assert mixing.poisson_mix(df.filter("false")).collect() == []
    assert mixing.poisson_mix(df, {"other": 1.0}).collect() == []


def test_many_sources_are_dealt(spark, monkeypatch):
    rows = [(i, "x" * (1 + i % 5), "hot" if i % 3 == 0 else f"s{i % 40}", "") for i in range(900)] + [(1000, "a", None, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    key = lambda out: sorted((r.doc_id, r.copy_no, r.shuffle_key) for r in out.collect())
    small = key(mixing.poisson_mix(df))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key(mixing.poisson_mix(df)) == small and len(small) > 500
