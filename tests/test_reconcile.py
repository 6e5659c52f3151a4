"""Rateless reconciliation by hash ranges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siftwood.operators import reconcile


def ids(spark, numbers):
    return spark.createDataFrame([(hashlib.sha256(str(i).encode()).digest(),) for i in numbers], "id binary")


def names(numbers):
    return {hashlib.sha256(str(i).encode()).digest() for i in numbers}


@pytest.mark.parametrize(("local", "remote"), [((0, 2000), (3, 2004)), ((0, 300), (0, 300)), ((0, 0), (0, 40)), ((0, 40), (0, 0)), ((0, 0), (0, 0)), ((0, 900), (450, 1350))])
def test_differences(spark, local, remote):
    found, report = reconcile.rateless(ids(spark, range(*local)), ids(spark, range(*remote)), ranges=5)
    got = {(bytes(r.id), r.side) for r in found.collect()}
    a, b = names(range(*local)), names(range(*remote))
    assert got == {(x, "added") for x in b - a} | {(x, "removed") for x in a - b}
    solved = report.filter("differences is not null")
    assert (solved.agg(F.sum("differences")).first()[0] or 0) == len(a ^ b)  # all by symbols


def test_symbols_follow_the_difference(spark):
    """Some three symbols a difference, whatever the sets' sizes, counted in rounds that double."""
    found, report = reconcile.rateless(ids(spark, range(30_000)), ids(spark, range(200, 30_200)), ranges=1)
    r = report.first()
    assert r.differences == 400 and found.count() == 400 and r.symbols <= 8 * 400
    one, few = reconcile.rateless(ids(spark, range(30_000)), ids(spark, range(1, 30_000)), ranges=1)
    assert one.count() == 1 and few.first().symbols <= 2 * reconcile.FIRST_SYMBOLS  # one in thirty items is in none of the first symbols


def test_what_symbols_dont_solve_meets_in_a_join(spark):
    a = ids(spark, [*range(500), *range(20)]).union(spark.createDataFrame([(None,)], "id binary"))
    found, report = reconcile.rateless(a, ids(spark, range(250, 1000)), ranges=3, most=64)
    got = [(bytes(r.id), r.side) for r in found.collect()]
    assert set(got) == {(x, "removed") for x in names(range(250))} | {(x, "added") for x in names(range(500, 1000))} and len(got) == 750
    assert report.filter("differences is null").count() > 0
