"""Crawling, pointers, gossip, followed snapshots, lists and large filters on small cases, and their queries against their SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwood.functions import bencode
from siftwood.operators import crawl, documents, peers, postings, records, sketches, transfers
from siftwood.plans import catalog, formats, state

SF = "/root/testdata/sf0.001"
A, B, ZERO = b"\x01" * 32, b"\x02" * 32, bytes(32)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents pages benchmark conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*formats.queries(), *state.QUERIES, "token_bucket", "bans_with_expiry"])
def test_query_equals_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_metainfo_classes():
    info, seed = bencode.encode({"length": 1, "name": "n"}), bytes(range(32))
    good = crawl.signed_metainfo(info, seed)
    kind, key = crawl.metainfo_class(good)
    assert kind == "forwarded" and crawl.metainfo_class(good.replace(b"1:n", b"1:m")) == ("bad_signature", key)
    cases = {b"d4:info" + info + b"e": "unsigned", b"": "malformed", b"i1e": "malformed", b"de": "malformed", b"d4:infodee": "malformed", good[:-1]: "malformed", None: "fetch_error"}
    assert {x: crawl.metainfo_class(x)[0] for x in cases} == cases
    short = bencode.encode({b"info": {b"a": 1}, crawl.KEY_FIELD: b"x", crawl.SIG_FIELD: bytes(64)})
    assert crawl.metainfo_class(short) == ("malformed", None)


def test_metainfos_are_classed_by_many_tasks_and_once_each(spark):
    infos = [bencode.encode({"length": i, "name": "n"}) for i in range(20)]
    raws = crawl.signed_metainfos(infos, B)
    assert raws[3] == crawl.signed_metainfo(infos[3], B)
    raws[5] = raws[5].replace(b"1:n", b"1:m")
    fetched = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "infohash string, raw binary").coalesce(1)
    samples = spark.createDataFrame([(str(i), n) for i in range(21) for n in range(3)], "infohash string, node int")
    out = crawl.crawled(samples, fetched)
    assert "RoundRobinPartitioning" in out._jdf.queryExecution().toString()
    assert {(r.infohash, r["class"]) for r in out.collect()} == {(str(i), {5: "bad_signature", 20: "fetch_error"}.get(i, "forwarded")) for i in range(21)}
    assert out.count() == 63


def test_samples_and_gossip(spark):
    rows = spark.createDataFrame([("n", A[:20] + B[:20] + b"x", 1, 2), ("m", b"", 1, 0), ("k", None, 1, 0)], "node string, samples binary, interval int, num int")
    assert [(r.node, r.place, r.infohash) for r in crawl.sampled(rows).orderBy("place").collect()] == [("n", 0, "01" * 20), ("n", 1, "02" * 20)]
    many = [bytes([i]) * 32 for i in range(3, 20)]
    announces = [("p", 1, A, [B, A, ZERO, b"short", B, None, *many]), ("q", 2, ZERO, [B]), ("r", 3, None, [B]), ("s", 4, A, None), ("t", 5, b"x", [A])]
    indexers, edges = crawl.gossip(spark.createDataFrame(announces, "peer string, seq int, pubkey binary, endorsed array<binary>"))
    assert [tuple(r) for r in indexers.collect()] == [(A.hex(), "gossip:p")]
    assert sorted(r.candidate for r in edges.collect()) == sorted(x.hex() for x in [B, *many[:4]])


def test_subscriber_round_replaces_and_is_idempotent(spark):
    file = "array<struct<index:int,path:string,size:bigint,mime:string,extractor:string,chunks:array<struct<text:string,offset:bigint>>>>"
    payloads = spark.createDataFrame([(1, "AA", "n", 1, 0, [(0, "f", 3, "m", "e", [("new", 0), ("more", 3)])])], f"snapshot int, infohash string, name string, size long, added_at long, files {file}")
    followed = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "publisher string")
    pointers = spark.createDataFrame([("k1", 1), ("k2", 9), ("k9", 1)], "publisher string, snapshot int")
    local = spark.createDataFrame([("aa", 0, "f", 3, "m", "old", "e", dt.datetime(2025, 1, 1), 0), ("bb", 0, "f", 3, "m", "kept", "e", None, 0)], documents.CHUNKS)
    now = F.lit("2024-01-01").cast("timestamp")
    one, results = crawl.round_of(followed, pointers, payloads, local, now)
    want = {("aa", 0, "new"), ("aa", 1, "more"), ("bb", 0, "kept")}
    assert {(r.infohash, r.chunk_index, r.text) for r in one.collect()} == want
    assert {tuple(r) for r in results.collect()} == {("k1", "synced", 1, 2), ("k2", "no_payload", 0, 0), ("k3", "no_pointer", 0, 0)}
    assert {(r.infohash, r.chunk_index, r.text) for r in crawl.round_of(followed, pointers, payloads, one, now)[0].collect()} == want
    for name in ("", "a/b", ".."):
        with pytest.raises(ValueError):
            crawl.fetched_path("/x", name)
    assert crawl.fetched_path("/x/", "index") == "/x/index"


def test_pointers_and_confirmation(spark):
    rows = [("a", bytes(20), None, None, None, 0), ("b", bytes(20), A, B, A, 5), ("c", bytes(19), None, None, None, 1), ("d", bytes(20), b"x", None, None, 1), ("e", None, None, None, None, 1), ("f", bytes(20), b"", b"", b"", None)]
    got = {r.publisher: (r.ts, r.bytes) for r in postings.pointers(spark.createDataFrame(rows, "publisher string, ih binary, commit binary, topics binary, next_pk binary, ts long"), 77).collect()}
    size = lambda d: len(bencode.encode(d))
    assert got == {"a": (77, size({"ih": bytes(20), "ts": 77})), "b": (5, size({"ih": bytes(20), "ts": 5, "commit": A, "topics": B, "next_pk": A})), "f": (77, size({"ih": bytes(20), "ts": 77}))}
    known = spark.createDataFrame([("K",)], "infohash string")
    moves = spark.createDataFrame([("A", True, None), ("B", False, "KEY"), ("C", False, "other"), ("D", False, None), ("k", True, "key")], "infohash string, complete boolean, signed_by string")
    assert sorted(r.infohash for r in crawl.confirmed(known, moves, spark.createDataFrame([("key",)], "publisher string")).collect()) == ["a", "b", "k"]


def test_sorted_lists(spark):
    rows = [(1, "b", True, "z"), (2, "a", True, ""), (3, "c", False, "y"), (4, "a", False, "")]
    df = spark.createDataFrame(rows, "infohash long, name string, indexing boolean, signed_by string")
    order = lambda c, desc=False: [r.infohash for r in transfers.sorted_by(df, c, desc).collect()]
    assert order("name") == [2, 4, 1, 3] and order("name", True) == [3, 1, 2, 4] and order(None) == [1, 2, 3, 4]
    assert order("indexing") == [4, 3, 2, 1] and order("signed_by") == [3, 1, 2, 4]
    with pytest.raises(ValueError):
        transfers.sorted_by(df, "colour")
    assert [r.place for r in transfers.numbered(df, "name").orderBy("place").collect()] == [1, 2, 3, 4]


def test_filters_above_the_sent_size(spark, monkeypatch):
    items = spark.range(500).select(F.concat(F.lit("i"), F.col("id").cast("string")).cast("binary").alias("item"))
    bits, k = sketches.bloom_size(250, 0.01)
    words = sketches.bloom_words(items.limit(250), bits, k)
    asked = items.union(spark.createDataFrame([(None,)], "item binary"))
    small = {(r.item and bytes(r.item), r.maybe) for r in sketches.bloom_flagged(asked, words, bits, k).collect()}
    monkeypatch.setattr(sketches, "SENT_BITS", 8)
    assert {(r.item and bytes(r.item), r.maybe) for r in sketches.bloom_flagged(asked, words, bits, k).collect()} == small
    with pytest.raises(ValueError):
        sketches.bloom_test(sketches.bloom_array(words, bits), bits, k)


def test_failures_since_the_last_success(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", at(0), False), ("a", at(1), True), ("a", at(2), False), ("a", at(3), False), ("b", at(4), False), ("c", at(5), None)]
    got = {r.peer: (r.tried, r.failures) for r in peers.peer_book(spark.createDataFrame(rows, "peer string, ts timestamp, ok boolean")).collect()}
    assert got == {"a": (True, 2), "b": (False, 1), "c": (False, 0)}


def test_prefix_reads_of_sorted_records(spark, tmp_path):
    rows = spark.range(3000).select(F.format_string("kw-%04d", F.col("id") % 300).alias("kw"), F.unhex(F.sha1(F.col("id").cast("string").cast("binary"))).alias("ih"), F.col("id").alias("t"))
    rows = rows.withColumns({"pk": F.lit(A), "pow": F.lit(0).cast("long"), "sig": F.lit(A + B)})
    records.write_sorted(rows, str(tmp_path / "r"))
    found = records.find(spark, str(tmp_path / "r"), "kw-012")
    assert found.count() == 100 and "StringStartsWith" in found._jdf.queryExecution().toString()
    assert records.range_fingerprints(rows).agg(F.sum("n")).first()[0] == 3000
