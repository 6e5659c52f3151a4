"""The query language on three known rows, and the index operators."""

import pytest
from pyspark.sql import functions as F

from siftwood.operators import documents, search


@pytest.fixture(scope="module")
def index(spark):
    rows = [("1" * 40, "river maps 1932 atlas coast9 ink"), ("2" * 40, "harbour plans netting coast9 ink"), ("3" * 40, "orchard notes pears")]
    return search.indexed(spark.createDataFrame(rows, "infohash string, name string"), "infohash", ["name"])


@pytest.mark.parametrize("q,want", [("orchard", "3"), ("+orchard", "3"), ("ink -harbour -orchard", "1"), ('"atlas coast9"', "1"), ('"coast9 atlas"', ""), ("name:plans", "2"), ("infohash:" + "2" * 40, "2"), ("+coast9 +netting", "2"), ("rivar~1", "1"), ("coast9", "12"), ("nosuch:x", "")])
def test_queries(index, q, want):
    assert sorted(r.infohash[0] for r in search.search(index, q, "infohash", ["name"], ["infohash"]).collect()) == list(want)


def test_empty_query_boost_and_highlight(index):
    with pytest.raises(ValueError):
        search.parse("  ")
    assert search.search(index, "river orchard^9", "infohash", ["name"]).first().infohash[0] == "3"
    row = search.search(index, "river", "infohash", ["name"], with_highlights=True).first()
    assert "<mark>river</mark>" in row.fragments["name"][0]


def test_upsert_delete_statistics(spark, tmp_path):
    now = F.lit("2024-01-01").cast("timestamp")
    none = spark.createDataFrame([], documents.PARENTS)
    row = lambda ih, name: (ih, name, ["a", "b"], None, 5, 0, None, None)
    one = documents.upsert_parents(none, spark.createDataFrame([row("AA", "x"), row("", "bad"), row("BB", "y")], documents.PARENTS), now)
    two = documents.upsert_parents(one, spark.createDataFrame([row("aa", "z")], documents.PARENTS), now)
    assert {(r.infohash, r.name, r.file_count) for r in two.collect()} == {("aa", "z", 2), ("bb", "y", 2)}
    chunks = spark.createDataFrame([("aa", 0, "f", 1, "m", "x" * 10, "e", None, i) for i in range(50)], documents.CHUNKS)
    mixed = documents.mixed(two, chunks)
    assert tuple(documents.statistics(mixed, 100).first())[:4] == (52, 2, 50, 500)
    assert tuple(documents.statistics(mixed.filter("false")).first()) == (0, 0, 0, 0, 0, 0.0)
    assert documents.deleted(two, spark.createDataFrame([("aa",), ("zz",)], "infohash string"), ["infohash"]).count() == 1
    documents.write_index(mixed, str(tmp_path / "i"))
    assert documents.open_index(spark, str(tmp_path / "i"), documents.PARENTS).count() == 52
    assert documents.open_index(spark, str(tmp_path / "none"), documents.PARENTS).count() == 0


def test_patterns_ranges_and_stored_index(spark, tmp_path):
    rows = [(1, "red ring of the north", ["a/ring.txt", "b/Nord.pdf"], 10, "k1"), (2, "red red rings", ["c.txt"], 20, "k2"), (3, None, [], 30, None), (4, "Ring², naïve ring 24", ["ring"], None, "k1")]
    docs = spark.createDataFrame(rows, "id long, name string, files array<string>, size long, signed_by string")
    fields, exact = ["name", "files"], ["size", "signed_by"]
    index = search.indexed(docs, "id", fields, exact)
    search.write_index(docs, "id", fields, str(tmp_path), exact, ["name"])
    want = {
        "ring": [1, 4], "rin*": [1, 2, 4], "r?ng": [1, 4], "/r.*g/": [1, 4], "name:ring": [1, 4], "files:txt": [1, 2], "size:>=20": [2, 3], "+ring size:<20": [1, 4], "+size:>10 -red": [3], '"red red"': [2], '"red ring"': [1], "signed_by:K1": [1, 4],
        "naïve": [4], "ring -naïve": [1], "size:<5": [], "+red +rings": [2], "rng~1": [1, 4], '"ring naïve"': [4], "nosuch:x": [], "nord": [1], '"naïve ring 24"^2': [4], "files:ring size:20": [1, 2, 4],
    }
    for q, ids in want.items():
        one = search.search(index, q, "id", fields, exact, stored=["signed_by"]).collect()
        two = search.search_index(spark, str(tmp_path), q, "id", fields, exact, stored=["name"]).collect()
        assert sorted(r.id for r in one) == ids and [(r.id, r.score) for r in one] == [(r.id, r.score) for r in two], q
    assert two[0].name and search.search(index, "ring", "id", fields, exact, limit=1, stored=["size", "signed_by"]).columns == ["id", "score", "size", "signed_by"]


def test_postings_of_single_rows_are_not_shuffled_and_shared_keys_meet(spark):
    rows = [(1, "river maps river ink"), (2, "maps"), (3, ""), (4, None), (None, "ink ink"), (None, "pears ink")]
    index = search.indexed(spark.createDataFrame(rows, "id long, text string"), "id", ["text"])
    one = search.postings(index.filter("id is not null"), "id", "text")
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id or 0, r.term, r.tf, r.positions) for r in search.postings(index, "id", "text").collect())
    assert got == [(0, "ink", 3, [0, 1, 1]), (0, "pears", 1, [0]), (1, "ink", 1, [3]), (1, "maps", 1, [1]), (1, "river", 2, [0, 2]), (2, "maps", 1, [0])]


def test_index_is_analysed_once_and_leaves_no_scratch(spark, tmp_path):
    rows = [(1, "river maps river"), (2, "maps ink")]
    search.write_index(spark.createDataFrame(rows, "id long, text string"), "id", ["text"], f"file://{tmp_path}/i", stored=["text"])
    assert sorted(p.name for p in (tmp_path / "i").iterdir() if p.is_dir()) == ["documents", "postings"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/i/postings").select("field", "term", "key", "tf", "positions").collect())
    assert got == [("text", "ink", 2, 1, [1]), ("text", "maps", 1, 1, [1]), ("text", "maps", 2, 1, [0]), ("text", "river", 1, 2, [0, 2])]
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/i/documents").select("id", "text", "_len_text").collect()) == [(1, "river maps river", 3), (2, "maps ink", 2)]


def test_records_of_a_sorted_table_are_made_by_many_tasks(spark):
    from siftwood.plans import catalog

    assert catalog._records(spark, "/root/testdata/sf0.001", dealt=True).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
