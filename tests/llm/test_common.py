"""Dealt joins, components and work folders."""

import pytest
from pyspark.sql import functions as F

from siftwood.llm import common


def test_dealt_join_equals_a_join_and_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_PIECE", 10)
    monkeypatch.setattr(common, "PIECES", 20)
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("m")).filter("k <> 9")
    out = common.dealt_join(rows, facts, ["k"], "c", 2000)
    want = rows.join(facts, "k")
    assert sorted(map(tuple, out.select("k", "id", "c", "m").collect())) == sorted(map(tuple, want.select("k", "id", "c", "m").collect()))
    none = common.dealt_join(rows.filter("false"), facts.filter("false"), ["k"], "c", 0)
    assert none.collect() == []


def test_components_of_long_chains_and_stars(spark, tmp_path):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    edges = spark.createDataFrame([*chain, *star, (3, 3), (9, 8), (8, 9)], "a long, b long")
    got = {r.node: r.component for r in common.connected(edges, f"file://{tmp_path}/c").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 3: 3, 8: 8, 9: 8}
    left = sorted(p.name[:5] for p in (tmp_path / "c").iterdir())
    assert len(left) <= 3
    with pytest.raises(RuntimeError):
        common.connected(edges, f"file://{tmp_path}/d", rounds=1)


def test_a_cluster_must_name_its_shared_folder():
    assert common._local_dir("local[4]").startswith("file://") and common._local_dir("local")
    with pytest.raises(ValueError):
        common._local_dir("spark://host:7077")
