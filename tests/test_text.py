"""Keywords, chunks, markup, prefixes."""

import pytest
from pyspark.sql import functions as F

from siftwood.functions import text as T


@pytest.mark.parametrize(
    "name,want",
    [
        ("Harbour Charts 19.07 Winter wx128", ["charts", "harbour", "winter", "wx128"]),
        ("how they sing and dance", ["dance", "sing"]),
        ("meadow-walk.7.2.flac", ["meadow", "walk"]),
        ("x of go oak tidal", ["oak", "tidal"]),
        ("Pebble PEBBLE pebble pEbBlE", ["pebble"]),
        ("tide_table-3.11[draft](coast9)", ["coast9", "draft", "table", "tide"]),
        ("...", []),
    ],
)
def test_keywords(spark, name, want):
    assert spark.range(1).select(T.sorted_keywords(F.lit(name)).alias("k")).first().k == want


def test_keyword_caps_and_salts(spark):
    many = "birch cedar maple aspen hazel rowan alder poplar larch spruce willow"
    row = spark.range(1).select(T.keywords(F.lit(many)).alias("a"), T.keywords(F.lit(many), None).alias("b"), T.keywords(F.lit("Grüne Äpfel, süß")).alias("c"), T.keyword_salt(F.lit("kw")).alias("d"), T.keyword_salt(F.lit("kw"), 2).alias("e"), T.keyword_salt(F.lit("k" * 65)).alias("f"), T.keywords(F.lit(None).cast("string")).alias("g")).first()
    assert len(row.a) == 8 and len(row.b) == 11 and len(row.c) == 3 and (row.d, row.e, row.f, row.g) == ("kw", "kw#2", None, [])


def test_chunks():
    assert T.chunks("one short note", 60) == [("one short note", 0)] and T.chunks(None) == T.chunks("\t \n") == []
    first, second = "lake " * 9, "hill " * 10
    assert T.chunks(f"{first}\n\n{second}", 50) == [(first, 0), (second, 47)]
    line = "0123456789" * 31
    pieces = T.chunks(line, 64)
    assert "".join(t for t, _ in pieces) == line and [o for _, o in pieces] == list(range(0, 310, 64))
    text = "\n\n".join(("ü" * n + " ") * 3 for n in (10, 80, 200, 5))
    for t, o in T.chunks(text, 100):
        assert len(t.encode()) <= 150 and text.encode()[o:].startswith(t.split("\n")[0].encode())


def test_subtitles_and_html():
    srt = "7\n00:01:10,500 --> 00:01:12,000\n<b>Rain</b> at\n{\\an2}noon\n\n8\n00:01:13,000 --> 00:01:14,250\n<u>Wind</u>\n"
    assert T.subtitle_text(srt) == "Rain at\nnoon\nWind"
    vtt = "WEBVTT\n\nNOTE not shown\n\n01:10.500 --> 01:12.000 line:0\n<c.low>Snow\n"
    assert T.subtitle_text(vtt) == "Snow" and T.subtitle_text(vtt, strict=True) == ""
    assert T.subtitle_text("[Events]\nDialogue: 1,0:01:10.00,0:01:12.00,Top,,0,0,0,,{\\i1}Fog\\Nand dew, late") == "Fog\nand dew, late"
    assert T.html_text('<p>a<br/>b</p><script>var t="</p>"</script><div> c &amp;  d</div>') == "a\nb\nc & d"


def test_small_helpers(spark):
    assert T.next_prefix(b"ab") == b"ac" and T.next_prefix(b"a\xff") == b"b" and T.next_prefix(b"\xff") is None
    assert T.sanitised(b"\xef\xbb\xbfa\xffb") == "a�b" and T.squeezed_lines("a \n\n\n b\n") == "a\n\n b"
    out = spark.range(1).select(T.highlight(F.lit("Two herons stood by the weir until dusk."), ["weir"]).alias("h")).first().h
    assert "<mark>weir</mark>" in out[0]


def test_references_without_a_semicolon():
    assert T.html_text("<p>a&amp<b>b</b> &amp; &#39;&lt;i&gt; &amp x & &nosuch; &copy</p>") == "a&b & '<i> & x & &nosuch; ©"
    assert T.html_text("<p>a&amp<b>b</b> &amp; &#39;&lt;i&gt; &amp x & &nosuch; &copy</p>", open_references=False) == "a&ampb & '<i> &amp x & &nosuch; &copy"


def test_texts_reach_python_in_short_batches(spark, tmp_path):
    from siftwood.plans import state as plans

    spark.createDataFrame([(1, "one short note"), (2, " \n"), (3, "\n\n".join("lake " * n for n in (300, 900, 20)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = plans.QUERIES["chunk_places"](spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    assert sorted(map(tuple, rows.collect())) == [(1, True, True, True), (3, True, True, True)]
