"""Merging, trust, records, sketches, snapshots and streams on small cases."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwood.functions import bencode, ed25519
from siftwood.operators import merge, peers, records, sketches, snapshot, transfers, trust

A, B = "a" * 40, "b" * 40


def test_lookup_and_swarm_merge(spark):
    rows = [(1, A, "River maps", 6 << 30, 100, 0), (2, A, "", 0, 130, 0), (3, B, "Harbour plans", 0, 50, 0), (4, "short", "x", 1, 1, 1)]
    hits = spark.createDataFrame(rows, "publisher long, infohash string, name string, size long, seeders long, files long")
    out = merge.ranked_lookup(merge.merge_lookup(hits), 10).collect()
    assert [(r.infohash, r.name, r.seeders, r.sources, r.size) for r in out] == [(A, "River maps", 130, [1, 2], 6 << 30), (B, "Harbour plans", 50, [3], 0)]
    assert out[0].score == pytest.approx(0.55)
    rows = [(1, A, "River maps", 6 << 30, 100, 500, ["f"]), (2, A, "", 0, 130, 400, []), (3, B, "Orchard", 1 << 30, 10, 300, None)]
    swarm = merge.ranked_swarm(merge.merge_swarm(spark.createDataFrame(rows, "peer long, infohash string, name string, size long, seeders long, rank long, matches array<string>")), 10).collect()
    assert [(r.infohash, r.score, r.seeders, r.sources) for r in swarm] == [(A, 900, 130, [1, 2]), (B, 300, 10, [3])]


def test_reputation(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    rows = [(0, 0, 0, None), (100, 0, 0, None), (10, 1, 9, None), (0, 0, 0, dt.datetime(2024, 1, 1)), (0, 0, 0, dt.datetime(2025, 1, 1)), (50, 0, 20, None), (9, 9, 0, dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "r long, c long, f long, s timestamp")
    got = [x[0] for x in df.select(trust.score(F.col("r"), F.col("c"), F.col("f"), F.col("s"), now)).collect()]
    assert got[0] == 0.5 and got[1] < 0.5 and 0 < got[2] < 0.5 and got[3] == got[4] == 0.95 and got[5] == pytest.approx(2.5 / 55) and got[6] == 1.0


def test_signatures():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")  # first vector of the RFC
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = ed25519.sign(seed, b"")
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert ed25519.verify(ed25519.public_key(seed), b"", sig) and not ed25519.verify(ed25519.public_key(seed), b"x", sig)


def test_many_signatures_at_once():
    seeds = [bytes([i]) * 32 for i in range(3)]
    texts = [b"%d" % i for i in range(30)]
    sigs = [ed25519.sign_all(s, texts) for s in seeds]
    assert all(sigs[k][i] == ed25519.sign(seeds[k], texts[i]) for k in range(3) for i in range(30))
    rows = [(ed25519.public_key(s), t, x) for s, many in zip(seeds, sigs, strict=True) for t, x in zip(texts, many, strict=True)]
    rows[4] = (rows[4][0], b"other", rows[4][2])
    rows[50] = (rows[50][0], rows[50][1], rows[50][2][:32] + bytes([rows[50][2][32] ^ 1]) + rows[50][2][33:])
    rows[70] = (b"short", *rows[70][1:])
    rows[71] = ((2**255 - 1).to_bytes(32, "little"), *rows[71][1:])  # no point
    assert [i for i, ok in enumerate(ed25519.verify_all(rows)) if not ok] == [4, 50, 70, 71]


def test_records_are_signed_by_many_tasks(spark):
    rows = spark.createDataFrame([("kw", bytes(20), i) for i in range(9)], "kw string, ih binary, t long").coalesce(1)
    signed = records.signed(rows, bytes(32))
    assert signed.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert records.verified(signed).count() == 9


def test_bencode():
    value = {"b": [1, -2, b"x"], "a": {"k": "v"}}
    assert bencode.encode(value) == b"d1:ad1:k1:ve1:bli1ei-2e1:xee" and bencode.encode(bencode.decode(bencode.encode(value))) == bencode.encode(value)
    with pytest.raises(ValueError):
        bencode.decode(b"i1ex")


def test_paged_tree():
    seed, pk = bytes(32), ed25519.public_key(bytes(32))
    rows = []
    for i in range(60):
        kw, ih = f"kw-{i % 7:04d}", hashlib.sha1(str(i).encode()).digest()
        rows.append((pk, kw, ih, i, 0, ed25519.sign(seed, records.message(pk, kw, ih, i, 0))))
    data = records.tree_file(rows, seed, 1, 2, page_size=1024)
    facts = records.trailer(data, 1024)
    assert facts["records"] == 60 and records.opened(data[:1024])[0] == records.ROOT and facts["pages"] >= 3
    for prefix in ("kw-0003", "kw-", "zz", "kw-0000"):
        assert records.tree_find(data, prefix, 1024) == [r for r in records.tree_records(data, 1024)[0] if r[1].startswith(prefix)]
    got, whole = records.tree_records(data, 1024)
    assert whole and sorted(got) == sorted(rows)
    with pytest.raises(ValueError):
        records.trailer(data[:-1] + b"\1" if data[-1] else data[:-1024] + bytes(1024), 1024)


def test_records(spark):
    assert records.zero_bits(b"\0\x10") == 11 and records.uvarint(300) == b"\xac\x02"
    n = records.mined(b"p" * 32, "kw", b"i" * 20, 5, 8)
    assert hashlib.sha256(records.message(b"p" * 32, "kw", b"i" * 20, 5, n)).digest()[0] == 0
    df = spark.createDataFrame([(b"p" * 32, "kw", b"i" * 20, 258)], "pk binary, kw string, ih binary, t long")
    want = hashlib.sha256(b"p" * 32 + b"kw" + b"i" * 20 + (258).to_bytes(8, "little")).hexdigest()
    assert df.select(records.identity(F.col("pk"), F.col("kw"), F.col("ih"), F.col("t")).alias("x")).first().x == want
    signed = records.signed(df.select("kw", "ih", "t"), bytes(32))
    assert records.verified(signed).count() == 1 and records.verified(signed.withColumn("t", F.lit(9).cast("long"))).count() == 0


def test_bloom(spark):
    assert sketches.fnv([b"a"])[0] == 0xAF63DC4C8601EC8C
    items = spark.createDataFrame([(f"k{i}".encode(),) for i in range(500)], "item binary").repartition(3)
    bits, k = sketches.bloom_size(500, 0.01)
    words = sketches.bloom_words(items, bits, k)
    array = sketches.bloom_array(words, bits)
    test = sketches.bloom_test(array, bits, k)
    assert items.filter(test(F.col("item"))).count() == 500
    other = spark.createDataFrame([(f"n{i}".encode(),) for i in range(500)], "item binary")
    assert other.filter(test(F.col("item"))).count() < 25
    assert abs(sketches.bloom_estimate(words, bits, k).first()["items"] - 500) < 40
    again, b, p = sketches.bloom_from(sketches.bloom_bytes(array, bits, k))
    assert np.array_equal(again, array) and (b, p) == (bits, k)
    with pytest.raises(ValueError):
        sketches.bloom_from(sketches.bloom_bytes(array, bits, k)[:-1])


@pytest.mark.parametrize("name", ["bloom_estimate", "bloom_flag"])
def test_bloom_queries_hold_where_an_even_filter_would_not(spark, tmp_path, name):
    """3409 items would get 32676 bits, and the probes of an even number overlap."""
    import duckdb

    from siftwood.plans import catalog

    spark.range(10000).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(3409).select((F.col("id") * 2).alias("doc_id"), F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] == con.execute(catalog.ORACLES[name]).fetchall()
    assert all(sketches.bloom_size(n, 0.01)[0] % 2 for n in range(1, 99))


def test_transfer_rate_leaves_out_samples_too_near(spark, tmp_path):
    import duckdb

    from siftwood.plans import catalog

    rows = "(1, timestamp_ntz'2024-01-01 00:00:00', 1, 5D), (2, timestamp_ntz'2024-01-01 00:00:00.05', 1, 6D), (4, timestamp_ntz'2024-01-01 00:00:01', 1, 9D), (3, timestamp_ntz'2024-01-01 00:00:01', 1, 7D), (5, timestamp_ntz'2024-01-01 00:00:03', 1, 10D)"
    spark.sql(f"select * from values {rows} as t(event_id, ts, user_id, value)").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["transfer_rate"]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["transfer_rate"](spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 3


@pytest.mark.parametrize("shared,remote,local", [(10, 5, 3), (500, 50, 50), (5, 0, 0), (0, 3, 0)])
def test_reconciliation(spark, shared, remote, local):
    ids = lambda kind, n: [(sketches.element(f"{kind}{i}"),) for i in range(n)]
    common, r, x = ids("s", shared), ids("r", remote), ids("l", local)
    a = spark.createDataFrame(common + x, "id binary")
    b = spark.createDataFrame(common + r, "id binary")
    added, removed, used = sketches.reconciled(a, b)
    assert added == sorted(i for (i,) in r) and removed == sorted(i for (i,) in x) and used <= 1000
    diff = sketches.set_difference(a, b).collect()
    assert sorted(bytes(d.id) for d in diff if d.side == "added") == added


@pytest.mark.parametrize("shared,remote,local,ranges", [(3000, 60, 50, None), (200, 2500, 3000, None), (20, 900, 900, 1), (5, 0, 0, None), (0, 3, 0, None), (0, 0, 0, None)])
def test_reconciliation_of_any_size(spark, shared, remote, local, ranges):
    ids = lambda kind, n: [(sketches.element(f"{kind}{i}"),) for i in range(n)]
    common, r, x = ids("s", shared), ids("r", remote), ids("l", local)
    a, b = spark.createDataFrame(common + x + x[:2], "id binary"), spark.createDataFrame(common + r, "id binary")
    got = sorted((bytes(d.id), d.side) for d in sketches.reconciled_ranges(a, b, ranges).collect())
    assert got == sorted([(i, "added") for (i,) in r] + [(i, "removed") for (i,) in x])


def test_snapshot_round_trip(spark, tmp_path):
    parents = spark.createDataFrame([(A, "n", 3, 0, ["x", "y"]), (B, "m", 1, 0, None)], "infohash string, name string, size long, added_at long, file_paths array<string>")
    content = spark.createDataFrame([(A, 1, 7, "t", "e", 1, "two", 9), (A, 1, 7, "t", "e", 0, "one", 0), (A, 5, 7, "t", "e", 0, "lost", 0)], "infohash string, file_index int, file_size long, mime string, extractor string, chunk_index int, text string, offset long")
    rows = snapshot.nested(parents, content)
    snapshot.write_snapshot(rows, str(tmp_path / "s"), "p", 5)
    again = snapshot.read_snapshot(spark, str(tmp_path / "s"))
    assert sorted(map(str, again.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert [(r.path, r.text) for r in snapshot.flattened(again).orderBy("chunk_index").collect()] == [("y", "one"), ("y", "two")]


def test_limits_and_transfers(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    reqs = spark.createDataFrame([("p", t(i * 0.01)) for i in range(15)] + [("p", t(2.0)), ("q", t(0))], "peer string, ts timestamp")
    got = [r.allowed for r in peers.rate_limited(reqs).orderBy("peer", "ts").collect()]
    assert got[:10] == [True] * 10 and not any(got[10:15]) and got[15:] == [True, True]
    charges = spark.createDataFrame([("p", t(i), 20) for i in range(6)] + [("p", t(90_000), 5)], "peer string, ts timestamp, points int")
    assert [(r.score, r.banned) for r in peers.bans(charges).orderBy("ts").collect()][3:] == [(80, False), (100, True), (120, True), (5, False)]
    files = spark.createDataFrame([("t", 0, 10), ("t", 1, 0), ("t", 2, 25)], "infohash string, file_index int, length long")
    spans = transfers.file_spans(files, 10)
    assert [(r.piece_begin, r.piece_end) for r in spans.orderBy("file_index").collect()] == [(0, 1), (1, 1), (1, 4)]
    pieces = spark.createDataFrame([("t", 1, t(1)), ("t", 3, t(2)), ("t", 2, t(3)), ("t", 1, t(9))], "infohash string, piece long, ts timestamp")
    assert {(r.file_index, r.completed_at) for r in transfers.completed_files(spans, pieces).collect()} == {(1, None), (2, t(3))}


def test_file_stream(spark, tmp_path):
    from siftwood.streaming import state

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello stream")
    (tmp_path / "in" / "b.bin").write_bytes(b"\0\1")
    seen = []
    q = state.file_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(state.upserting(lambda b, n: seen.extend(r.text for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == ["hello stream"]
    src = spark.createDataFrame([("t", 0, i % 3, 3) for i in range(7)], "infohash string, file_index int, piece long, needed int")
    src.write.parquet(str(tmp_path / "p"))
    q = state.completed_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "p"))).writeStream.format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("done").collect()] == [("t", 0)]


def test_random_difference_is_symmetric(spark):
    rng = random.Random(3)
    a = {rng.randrange(60) for _ in range(30)}
    b = {rng.randrange(60) for _ in range(30)}
    diff = sketches.set_difference(spark.createDataFrame([(x,) for x in a], "id long"), spark.createDataFrame([(x,) for x in b], "id long")).collect()
    assert {d.id for d in diff if d.side == "added"} == b - a and {d.id for d in diff if d.side == "removed"} == a - b


def test_marks_are_attributed_in_one_plan(spark):
    from siftwood.operators import trust

    marks = spark.createDataFrame([("a",), ("a",), ("b",), ("x",), (None,)], "infohash string")
    hits = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), ("c", 3), (None, 3)], "infohash string, publisher long")
    publishers = spark.createDataFrame([(1,), (2,), (3,), (3,)], "publisher long")
    count = lambda fallback: sorted(map(tuple, trust.attributed(marks, hits, publishers, fallback).collect()))
    assert count("all") == [(1, 4), (2, 5), (3, 2)] and count("none") == [(1, 2), (2, 3)]
    trust.attributed(marks, hits.withColumn("infohash", F.raise_error(F.lit("read while planning")).cast("string")), publishers)
