"""Records as lists of keywords against the operators on single records."""

import pytest
from pyspark.sql import functions as F

from siftwood.operators import postings, reconcile, records, sketches
from siftwood.plans import catalog

PK, OTHER, A, B = b"p" * 32, b"q" * 32, b"a" * 20, b"b" * 20
#: key, infohash, time, keywords, arrival
ROWS = [(PK, A, 1, ["x", "y"], 1), (PK, A, 1, ["x", "y"], 4), (PK, A, 1, ["y", "z", "y"], 3), (PK, A, 2, ["x"], 5), (OTHER, A, 1, ["x"], 6), (PK, B, 1, ["x", "y"], 7), (PK, B, 9, [], 8), (PK, None, 1, ["x", "y"], 9), (PK, A, None, ["z"], 10)]
MORE = [(PK, A, 1, ["x", "y"], 1), (PK, B, 1, ["y", "x"], 2), (PK, B, 2, ["x"], 3), (OTHER, A, 1, ["x", "w"], 4), (PK, None, 1, ["x"], 5)]


@pytest.fixture(scope="module")
def sides(spark):
    return [spark.createDataFrame(x, "pk binary, ih binary, t long, kws array<string>, seq long") for x in (ROWS, MORE)]


def single(lists):
    return lists.select("pk", F.explode("kws").alias("kw"), "ih", "t", "seq")


def ids(lists):
    return single(lists).select(records.identity(F.col("pk"), F.col("kw"), F.col("ih"), F.col("t")).alias("id"))


def test_distinct_as_single_records(spark, sides):
    for x in sides:
        want = sorted(records.distinct_records(single(x)).select("id", "seq").collect(), key=str)
        assert sorted(records.distinct_in_lists(x).collect(), key=str) == want
    assert records.distinct_in_lists(sides[0].limit(0)).count() == 0


def test_differences_as_single_records(spark, sides):
    for a, b in (sides, sides[::-1], (sides[0], sides[0]), (sides[0], sides[1].limit(0))):
        want = sorted(sketches.set_difference(ids(a), ids(b)).collect())
        assert sorted(records.difference_of_lists(a, b).collect()) == want
        assert sorted(reconcile.reconciled_lists(a, b).collect()) == want


def test_records_are_not_shuffled(spark, tmp_path):
    rows = [(i, "alpha beta gamma", "en", "s", 16) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("record_identity_dedupe", "set_diff_both", "need_and_missing"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" not in plan and "hashpartitioning(pk" in plan


def test_postings_are_shuffled_once(spark):
    hits = spark.createDataFrame([(1, "k", "h", "n", 1, 1, 0, 1)], "publisher long, keyword string, infohash string, name string, seeders long, size long, files long, seq long")
    for rows in (postings.as_lists(postings.bounded_lists(hits)), postings.bounded_lists(hits)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
