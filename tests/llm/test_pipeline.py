"""The pipeline stage by stage against plain computations on its own input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from siftwood.llm import token_ids
from siftwood.llm.common import saved, shared_dir

from .test_decontaminate import brute as passages
from .test_jaccard import brute as groups


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs, inputs = spark.read.parquet(f"{d}/documents.parquet"), []
    work = shared_dir(spark)
    for k, (_, stage) in enumerate(cp.STAGES):
        inputs.append(docs)
        docs = saved(stage(spark, docs, d), f"{work}/{k}")
        assert k == len(cp.STAGES) - 1 or docs.columns == cp.COLUMNS
    rows = [x.collect() for x in [*inputs, docs]]
    ids = [[r.doc_id for r in x] for x in rows]
    assert len(ids[1]) >= 0.98 * len(ids[0])
    comp = groups([(r.doc_id, r.text) for r in rows[1]], cp.SHINGLE_WORDS, cp.SIMILARITY, 100)
    assert sorted(ids[2]) == sorted(i for i, (_, c) in comp.items() if c == i)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert sorted(ids[3]) == sorted(r.doc_id for r in rows[2] if not passages(r.text, items)[1])
    assert set(ids[4]) <= set(ids[3])
    encode, at = token_ids.Encoder.of(token_ids.default_tokenizer()), 0
    text = {r.doc_id: r.text for r in rows[4]}
    for r in sorted(rows[5], key=lambda r: r.start):
        want = np.append(encode._plain([text[r.doc_id]])[0], np.uint32(2)).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert [r.doc_id for r in sorted(rows[5], key=lambda r: r.start)] == sorted(ids[4])


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " more", "quite another text of a few words only"
    rows = [
        (5, text, "en", "a", 1), (5, text, "en", "a", 1), (5, text, "en", "a", 1), (None, text, "en", "a", 1), (None, near, "en", "a", 1), (7, near, "en", "b", 1),
        (None, other, "en", "b", 1), (None, other, "en", "b", 1), (8, "one of a kind", "en", "c", 1), (8, "another of its id", "en", "c", 1), (9, "", "en", "c", 1), (9, None, "en", "c", 1), (10, "", "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()]
    want = [(5, text), (None, other), (8, "one of a kind"), (8, "another of its id"), (9, ""), (9, None), (10, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with clashing names, empty tables."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    some = real.first().text
    rows = [(None, some, None, None, None), (-1, None, "en", "a", 0), (-2, "", "en", None, 0), (-2, "", "en", None, 0), (-3, some * 400, "en", "a", 9), (-4, "7 8 9", None, "a", 5), (-5, "\x00 \U0001f600", "zz", "b", 3)]
    docs = real.union(spark.createDataFrame(rows, real.schema))
    for c in ("_row", "rejected", "component_id", "n_hit", "copy_no", "start", "_u"):
        docs = docs.withColumn(c, F.lit("x"))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, table, items in (("odd", docs, bench.withColumn("text", F.when(F.col("item_id") % 5 > 0, F.col("text")))), ("none", docs.filter("false"), bench), ("clean", docs, bench.filter("false"))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(cp.STAGES):
            now = saved(stage(spark, now, folder), f"{folder}/stage{k}")
            assert now.columns == (cp.COLUMNS if k < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"])
            if k == 0 and name != "none":
                kept = [(r.doc_id, r.text) for r in now.collect()]
                assert not {-1, -2, -4} & {i for i, _ in kept} and (-3, some * 400) in kept and (None, some) in kept
            if k == 1 and name != "none":
                texts = [r.text for r in now.collect()]
                assert texts.count(some) == 0 and texts.count(some * 400) == 1  # of one group: the smallest id stays
            if k < 4:
                now = now.withColumn("n_words", F.lit("x")).withColumn("lang_pred", F.lit(1))
        assert (now.count() == 0) == (name == "none")


def test_run_keeps_only_the_last_table(spark, tmp_path, monkeypatch):
    names = iter(["w", *map(str, range(99))])
    monkeypatch.setattr(cp, "shared_dir", lambda s: f"file://{tmp_path}/{next(names)}")
    out = cp.run(spark, "/root/testdata/sf0.001")
    ids = sorted((r.start, r.n_tokens) for r in out.collect())
    assert ids[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ids, ids[1:], strict=False))
    assert sorted(p.name for p in (tmp_path / "w").iterdir() if p.name.startswith("stage")) == ["stage4"]
