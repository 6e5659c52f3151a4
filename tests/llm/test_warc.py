"""WARC archives: exact round trip, revisits, rolling, determinism."""

import hashlib

import pytest

from siftwood.llm import warc

BIG = "<p>" + "x" * 200 + "</p>"


def pages(spark):
    rows = [(5, "http://a/é b%\n", BIG), (3, "http://b", BIG), (9, None, BIG), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n" + BIG), (3, "http://b", BIG), (8, "u", "ü" * 60), (None, "n", BIG), (10, "u", "ü" * 60)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3), rows


def test_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    manifest = warc.write_warc(df, f"file://{tmp_path}/w", roll_bytes=600)
    got = warc.read_warc(manifest).collect()
    assert manifest.count() > 2 and sum(r.n_records for r in manifest.collect()) == len(rows) == len(got)
    for r in manifest.collect():
        data = open(r.path.removeprefix("file://"), "rb").read()
        assert len(data) == r.n_bytes and hashlib.sha256(data).hexdigest() == r.sha256
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((t or "").encode()), sha(t)) for i, _, t in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (9, "revisit", 3), (1, "response", None), (2, "response", None), (8, "response", None), (10, "revisit", 8), (None, "response", None)} <= kinds
    assert {r.url for r in got if r.page_id == 5} == {"http://a/é b%\n"}
    again = warc.write_warc(df, f"file://{tmp_path}/v", roll_bytes=600)
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in manifest.collect())
    assert not list((tmp_path / "w").glob("*.tmp"))


def test_damage_is_noticed(spark, tmp_path):
    manifest = warc.write_warc(pages(spark)[0], f"file://{tmp_path}/w")
    path = manifest.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-20])
    with pytest.raises(Exception, match="cut|incorrect|Error"):
        warc.read_warc(manifest).collect()


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
