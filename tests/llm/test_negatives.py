import math
import random

from pyspark.sql import functions as F

from siftwood.llm import negatives

COLUMNS = "vec_id long, label int, embedding array<float>, rank string, score string"


def brute(rows, every, k=5):
    usable = []
    for vec_id, label, e, *_ in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (vec_id, label, tuple(math.floor(256 * x) for x in e))
        if row not in usable:
            usable.append(row)
    first = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for a, label, v in usable:
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), b, other) for b, other, w in usable if len(w) == len(v)]
        for score, p, _ in first([x for x in scored if x[2] == label and x[1] != a])[:k]:
            fit = first([x for x in scored if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score])[:k]
            out += [(a, p, i + 1, n, score, s) for i, (s, n, _) in enumerate(fit)]
    return sorted(map(str, out))


def mined(spark, rows, every):
    table = spark.createDataFrame(rows, COLUMNS)
    v = table.select("vec_id", "label", negatives.quantised(F.col("embedding")).alias("v"), "rank")
    return sorted(str(tuple(r)) for r in negatives.mine(v, F.col("vec_id") % every == 0).collect())


def vectors(rng, n, d=3):
    """Rows in a few clouds, so that scores tie and labels mix."""
    return [(i, rng.randrange(4), [rng.choice([0.5, -0.5, 0.1]) + rng.choice([0, 0.01, 0.02]) for _ in range(d)], "", "") for i in range(n)]


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    rows = vectors(rng, 300) + vectors(rng, 20, 2)[10:]
    rows += [(500 + i, 1, [0.5, 0.5, 0.5], "", "") for i in range(60)]  # one vector many times
    rows += [(600, None, [1.0, 1.0, 1.0], "", ""), (601, 1, None, "", ""), (602, 1, [1.0, None, 1.0], "", ""), (603, 1, [float("nan"), 1.0, 1.0], "", ""), (604, 2, [float("inf"), 1.0, 1.0], "", "")]
    rows += [rows[0], rows[40], (None, 2, [0.5, 0.5, 0.49], "", ""), (700, 1, [], "", ""), (701, 2, [], "", ""), (720, 3, [0.0, 0.0, 0.0], "", "")]
    got = mined(spark, rows, 10)
    assert got == brute(rows, 10) and len(got) > 300


def test_small_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "SLICE", 2)
    monkeypatch.setattr(negatives, "FIRST", 2)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    monkeypatch.setattr(negatives, "GROUP", 8)
    monkeypatch.setattr(negatives, "SAMPLE", 50)
    rng = random.Random(4)
    rows = vectors(rng, 200) + [(500 + i, 1, [0.5, 0.5, 0.5], "", "") for i in range(100)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_no_rows(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(0, 1, None, "", "")], 10) == []


def test_bounds_skip_lists(spark):
    """Lists that can't hold a wanted row aren't asked for."""
    import numpy as np

    index = {2: (np.array([0, 1, 2]), np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]]), np.array([5.0, 5.0, 5.0]), [1, 1, 1])}
    v = np.array([100.0, 0.0]).tobytes()
    member = [(0, 0, 1, v, [(0, float("-inf"), float("inf"), 9000.0)]), (1, 1, 1, v, [(0, -1000.0, 1000.0, float("-inf"))])]
    kind = "members array<struct<aid:long,vec_id:long,label:long,v:binary,targets:array<struct<target:int,low:double,high:double,worst:double>>>>"
    asked = negatives._requests(spark.createDataFrame([(member,)], kind), index, 0, 3).collect()
    assert sorted((r.list, tuple(m.aid for m in r.members)) for r in asked) == [(0, (0,)), (1, (1,))]


def test_requests_are_packed_and_wide_rows_are_read_few_at_a_time(spark):
    """A request holds some 2 bytes a component of its anchors, not 8 in nested rows, of which a task would decode thousands at once."""
    import pickle

    import numpy as np

    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 40, (200, 64)))
    member = [(i, i, 1, x.tobytes(), [(j, 0.0, 9e4, float("-inf")) for j in range(5)]) for i, x in enumerate(v)]
    kind = "members array<struct<aid:long,vec_id:long,label:long,v:binary,targets:array<struct<target:int,low:double,high:double,worst:double>>>>"
    index = {64: (np.arange(2), np.zeros((2, 64)), np.full(2, 1e6), [1, 1])}
    asked = negatives._requests(spark.createDataFrame([(member,)], kind), index, 0, 2).collect()
    assert [len(r.members) for r in asked] == [200, 200]
    assert max(len(pickle.dumps([bytes(x) for x in r if isinstance(x, bytes | bytearray)] + [m.asDict(True) for m in r.members])) for r in asked) < 200 * 200
    assert (negatives._open(asked[0].anchors, 200) == v).all()
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    with negatives._short_batches(spark):
        assert int(spark.conf.get(name)) <= 64
    assert spark.conf.get(name) == before


def test_large_whole_numbers_stay_exact(spark):
    """Components beyond 16 and 32 bits are packed as they are."""
    import numpy as np

    rng = random.Random(6)
    rows = [(i, i % 3, [rng.choice([1, 200, 1e4]) * rng.choice([0.5, 1.0, -1.0]), rng.random()], "", "") for i in range(120)]
    assert mined(spark, rows, 10) == brute(rows, 10)
    for x in ([0.0, -32768.0], [32768.0, 1.0], [2.0**31, 1.0], [0.5, 1e300]):
        assert negatives._open(negatives._shut(negatives._narrow(np.array(x))), 1).tolist() == [x]
