"""Paged trees written by many tasks, and the source that reads them."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwood.operators import pages, records
from siftwood.session import work_dir
from siftwood.sources import paged

SEED = bytes(range(32))


def greedy(sizes, room):
    """Items that open a page, by the sequential rule."""
    out, used = [], None
    for i, x in enumerate(sizes):
        if used is None or used + x > room:
            out.append(i)
            used = 0
        used += x
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_page_boundaries_are_those_of_the_sequential_rule(spark, parts):
    rng = random.Random(parts)
    sizes = [rng.choice([1, 2, 9, 50, 99]) for _ in range(1500)]
    cuts = sorted(rng.sample(range(len(sizes)), parts - 1))
    part = np.searchsorted(cuts, np.arange(len(sizes)), "right")
    rows = [(int(p) * 3, i, s) for i, (p, s) in enumerate(zip(part, sizes, strict=True))]
    items = spark.createDataFrame(rows, "part int, place long, size int")
    entries, n = pages._entries(items, 100)
    got = pages._numbered(items, entries, 100).orderBy("place").collect()
    want = greedy(sizes, 100)
    assert [r.place for r in got if r.opens] == want and n == len(want)
    assert [r.page for r in got] == (np.searchsorted(want, np.arange(len(sizes)), "right") - 1).tolist()


def test_an_item_larger_than_a_page_fails():
    with pytest.raises(ValueError):
        pages.chains(np.array([3, 101]), 100)


def made(spark, n, copies=1):
    rng = random.Random(7)
    rows = [(f"{rng.choice(['ab', 'abc', 'b', 'é', 'zz'])}{rng.randrange(40)}", hashlib.sha1(str(i).encode()).digest(), i) for i in range(n)] * copies
    table = spark.createDataFrame(rows, "kw string, ih binary, t long")
    return table.select(F.lit(bytes(32)).alias("pk"), "kw", "ih", "t", F.lit(0).cast("long").alias("pow"), F.lit(bytes(64)).alias("sig"), F.lit("clash").alias("page"))


def test_tree_round_trip_and_pruned_prefixes(spark, monkeypatch):
    monkeypatch.setattr(pages, "FILE_PAGES", 16)
    monkeypatch.setattr(paged, "RUN_PAGES", 8)
    table, folder = made(spark, 3000, copies=2), work_dir(spark)
    facts = pages.write_tree(table.repartition(5), folder, SEED, page_size=1024)
    assert facts["records"] == 6000 and facts["levels"][-1] == 1 and len(facts["levels"]) >= 4
    tree = paged.Pages(folder, 1024)
    assert tree.trailer()["fingerprint"].hex() == facts["fingerprint"]
    for prefix in ("abc1", "ab", "é", "zz39", "nothing", "", "zzz"):
        got = paged.read_tree(spark, folder, 1024).filter(F.col("kw").startswith(prefix))
        rows = [(r.kw, bytes(r.ih), r.t) for r in got.collect()]
        want = [(r.kw, bytes(r.ih), r.t) for r in table.filter(F.col("kw").startswith(prefix)).collect()]
        assert sorted(rows) == sorted(want)
        start, stop = paged.Pages(folder, 1024).overlap(prefix)
        within = [r.page for r in paged.read_tree(spark, folder, 1024).select("kw", "page").collect() if r.kw.startswith(prefix)]
        assert not within or (start in (min(within), min(within) - 1) and stop - 1 in (max(within), max(within) + 1))
    asked = paged.Pages(folder, 1024)
    asked.overlap("abc1")
    assert asked.reads == 2 * len(facts["levels"])  # a page a level and end


def merkle(tree, i):
    kind, _, payload = records.opened(tree.one(i))
    if kind == records.LEAF:
        return hashlib.sha256(b"".join(c for c, _ in records._items(payload, 0))).digest()
    return hashlib.sha256(b"".join(merkle(tree, struct.unpack("<I", at)[0]) for _, at in records._items(payload, 4))).digest()


def test_fingerprint_and_leaves_equal_one_file(spark):
    """Leaf pages are those of the small-set writer, and the fingerprint is the root of their digests."""
    table, folder = made(spark, 400), work_dir(spark)
    facts = pages.write_tree(table, folder, SEED, page_size=2048)
    tree = paged.Pages(folder, 2048)
    assert merkle(tree, 0).hex() == facts["fingerprint"]
    rows = [(bytes(r.pk), r.kw, bytes(r.ih), r.t, r.pow, bytes(r.sig)) for r in table.collect()]
    one = records.tree_file(rows, SEED, 1, 0, page_size=2048)
    assert len(one) == facts["pages"] * 2048 and all(one[2048 * i : 2048 * (i + 1)] == tree.one(i) for i in range(facts["pages"] - 1))


def test_bad_records_fall_out_when_verified(spark):
    good = records.signed(spark.createDataFrame([(f"k{i}", bytes(20), i) for i in range(30)], "kw string, ih binary, t long"), SEED)
    bad = good.limit(5).withColumn("t", F.col("t") + 100)
    folder = work_dir(spark)
    pages.write_tree(good.union(bad), folder, SEED, page_size=1024)
    assert paged.read_tree(spark, folder, 1024).count() == 35 and paged.read_tree(spark, folder, 1024, verify=True).count() == 30


def test_no_records(spark):
    with pytest.raises(ValueError):
        pages.write_tree(made(spark, 1).limit(0), work_dir(spark), SEED)


def test_leaves_are_placed_without_a_shuffle(spark):
    """Records go to their leaves once, in one form: no sort by part before the one by file, no second copy of the bytes."""
    items = spark.range(0, 500, 1, 3).select((F.col("id") % 3).cast("int").alias("part"), F.floor(F.col("id") / 3).alias("place"), (F.col("id") % 7 + 3).cast("int").alias("size")).localCheckpoint()
    entries, _ = pages._entries(items, 40)
    numbered = pages._numbered(items, entries, 40)
    opening = numbered.filter("opens").select(F.col("part").alias("at_part"), F.col("place").alias("at_place"))
    placed = pages._placed(items, entries, opening)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r.part, r.place, r.page) for r in df.collect())
    assert rows(placed) == rows(numbered)
    assert pages._behind_length(b"\x85\x01abc") == b"abc" and pages._behind_length(b"\x03abc") == b"abc"


def test_files_of_pages_are_small(spark, tmp_path):
    """Pages are compressed on disk, a frame at a time, and scratch is gone in the end; any page can still be read alone."""
    folder = work_dir(spark)
    facts = pages.write_tree(made(spark, 3000), folder, SEED, page_size=4096)
    tree = paged.Pages(folder, 4096)
    files = [x for x in tree.system.get_file_info(pages.fs.FileSelector(tree.path)) if x.base_name.startswith("pages-")]
    assert len(files) == len(tree.first) and sum(x.size for x in files) < facts["pages"] * 4096 / 3
    assert [i for i, _ in tree.read(3, facts["pages"])] == list(range(3, facts["pages"])) and all(len(tree.one(i)) == 4096 for i in range(facts["pages"]))


def test_sizes_are_those_of_encoded_records(spark):
    """Also with proofs above 63 bits, times below 0 and letters of two bytes; what can't be encoded raises an error."""
    rows = [(bytes(32), kw, bytes(20), t, p, bytes(64)) for kw in ("a", "éé", "x" * 64) for t in (0, -7, 10**12) for p in (0, 9, 10**15, -1) if len(kw) < 60 or p < 10]
    rows = [r for r in rows if not (len(r[1]) == 64 and r[4] < 0)]
    stored = spark.createDataFrame(rows, records.SCHEMA).coalesce(1).withColumn("at", F.monotonically_increasing_id())
    want = [len(c) + len(records.uvarint(len(c))) for c in (records.encoded(*r) for r in rows)]
    assert [r["size"] for r in pages._sized(stored).orderBy("place").collect()] == want
    for t, p in ((-(10**18), -1), (None, 0)):
        bad = spark.createDataFrame([(bytes(32), "x" * 64, bytes(20), t, p, bytes(64))], records.SCHEMA)
        with pytest.raises(Exception, match="record length"):
            pages.write_tree(bad, work_dir(spark), SEED)


def test_leaves_are_written_from_sorted_columns(spark, monkeypatch, tmp_path):
    """When leaves are written, scratch holds the records' columns and not their encoded bytes; behind it only the tree is left, its leaves as full as the sequential rule makes them."""
    table, folder, seen, write = made(spark, 3000), f"file://{tmp_path}/tree", [], pages._leaves
    held = lambda name: sum(x.stat().st_size for x in (tmp_path / name).rglob("*") if x.is_file())
    monkeypatch.setattr(pages, "FILE_PAGES", 16)
    monkeypatch.setattr(pages, "work_dir", lambda spark: f"file://{tmp_path}/work")
    monkeypatch.setattr(pages, "_leaves", lambda *a: (seen.append(held("work")), write(*a))[1])
    facts = pages.write_tree(table.repartition(6), folder, SEED, page_size=2048)
    rows = sorted((r.kw.encode(), bytes(r.ih), records.encoded(bytes(r.pk), r.kw, bytes(r.ih), r.t, r.pow, bytes(r.sig))) for r in table.collect())
    sizes = [len(c) + 2 for *_, c in rows]
    assert 0 < seen[0] < sum(sizes) / 2 and held("work") == 0
    opens = greedy(sizes, pages.capacity(2048))
    got = paged.read_tree(spark, folder, 2048).groupBy("page").count().orderBy("page").collect()
    assert [r["count"] for r in got] == np.diff([*opens, len(rows)]).tolist() and facts["levels"][0] == len(opens)


def test_records_go_as_their_leaves_are_written(spark, monkeypatch, tmp_path):
    """Scratch shrinks from step to step, and nothing of it is needed again."""
    seen, write = [], pages._leaves
    monkeypatch.setattr(pages, "FILE_PAGES", 4)
    monkeypatch.setattr(pages, "work_dir", lambda spark: f"file://{tmp_path}/work")
    monkeypatch.setattr(pages, "_leaves", lambda *a: (seen.append(len(list((tmp_path / "work/records").glob("part-*.parquet")))), write(*a))[1])
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        facts = pages.write_tree(made(spark, 1500), f"file://{tmp_path}/tree", SEED, page_size=2048)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) > 4 and seen == sorted(seen, reverse=True) and seen[0] >= 3 > 1 >= seen[-1]
    assert facts["records"] == 1500 == paged.read_tree(spark, f"file://{tmp_path}/tree", 2048).count()
