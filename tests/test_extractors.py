"""Extractors on files made in memory."""

import io
import lzma
import struct
import tarfile
import zipfile
import zlib

import pytest
import zstandard

from siftwood.plans import formats
from siftwood.sources import extractors as x


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def vorbis(*pairs):
    return struct.pack("<I", 3) + b"abc" + struct.pack("<I", len(pairs)) + b"".join(struct.pack("<I", len(p)) + p for p in pairs)


def atom(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def ebml(kind, body):
    return bytes.fromhex(kind) + bytes([0x80 | len(body)]) + body


def tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n in ("b.txt", "a/c.txt"):
            t.addfile(tarfile.TarInfo(n), io.BytesIO())
    return out.getvalue()


def exif():
    t = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, 6, 60) + struct.pack("<HHII", 0x8825, 4, 1, 70)
    t = t.ljust(60, b"\0") + b"Lumix\0"
    t = t.ljust(70, b"\0") + struct.pack("<H", 4)
    for tag, kind, n, v in ((1, 2, 2, b"N\0\0\0"), (2, 5, 3, struct.pack("<I", 130)), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, struct.pack("<I", 160))):
        t += struct.pack("<HHI", tag, kind, n) + v
    t = t.ljust(130, b"\0") + struct.pack("<6I", 48, 1, 30, 1, 0, 1)
    t = t.ljust(160, b"\0") + struct.pack("<6I", 2, 1, 15, 1, 0, 1)
    body = b"Exif\0\0" + t
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


ID3_BODY = b"TIT2" + struct.pack(">I", 5) + b"\0\0" + b"\3Reel" + b"COMM" + struct.pack(">I", 9) + b"\0\0" + b"\0engd\0hey"
PDF = b"%PDF-1.4\n1 0 obj<</Filter/FlateDecode>>stream\n" + zlib.compress(b"BT (Tide \\(low\\)) Tj T* <5265656473> Tj ET") + b"\nendstream"
OGG_BODY = b"OpusTags" + vorbis(b"title=Aire")
CASES = {
    "a.txt": ("plaintext", b"hello", "hello"),
    "a.html": ("plaintext", b"<p>raw</p>", "<p>raw</p>"),
    "a.srt": ("subtitle", b"1\n00:00:01,000 --> 00:00:02,000\nHi\n", "Hi"),
    "a.epub": ("epub", zipped(b_dot_xhtml="<p>two</p>", a_dot_html="<p>one</p>", **{"META-INF__x_dot_html": "<p>no</p>"}), "one\n\ntwo"),
    "a.docx": ("docx", zipped(**{"word__document_dot_xml": '<w:d xmlns:w="u"><w:p><w:r><w:t>One</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:d>'}), "One x\n\nTwo"),
    "a.odt": ("odt", zipped(content_dot_xml='<o:c xmlns:o="u"><o:automatic-styles>no</o:automatic-styles><o:h>Head</o:h><o:p>a<o:s/>b</o:p></o:c>'), "Head\n\na b"),
    "a.odp": ("odp", zipped(content_dot_xml='<o:c xmlns:o="u"><o:p>slide</o:p></o:c>'), "slide"),
    "a.pptx": ("pptx", zipped(**{f"ppt__slides__slide{n}_dot_xml": f'<a:d xmlns:a="u"><a:p><a:t>s{n}</a:t></a:p></a:d>' for n in (10, 2)}), "s2\n\ns10"),
    "a.pdf": ("pdf", PDF, "Tide (low)\nReeds"),
    "a.rtf": ("rtf", rb"{\rtf1{\fonttbl x;}Hello\par \u233?w\'e9 {\*\x no}end\ldblquote}", "Hello\néwé end“"),
    "a.fb2": ("fb2", b"<f><binary>no</binary><section><title><p>T</p></title><p>text</p></section></f>", "T\n\ntext"),
    "a.mp3": ("id3", b"ID3\3\0\0" + bytes([0, 0, 0, len(ID3_BODY)]) + ID3_BODY, "Title: Reel\nComment: hey"),
    "a.flac": ("flac", b"fLaC\x84" + len(vorbis(b"ARTIST=Me")).to_bytes(3, "big") + vorbis(b"ARTIST=Me"), "Artist: Me"),
    "a.ogg": ("ogg", b"OggS" + bytes(22) + bytes([1, len(OGG_BODY)]) + OGG_BODY, "Title: Aire"),
    "a.mkv": ("mkv", bytes.fromhex("1a45dfa3") + b"\x80" + ebml("18538067", ebml("1549a966", ebml("7ba9", b"Mist"))), "Title: Mist"),
    "a.mp4": ("mp4", atom(b"ftyp", b"isom") + atom(b"moov", atom(b"udta", atom(b"meta", bytes(4) + atom(b"ilst", atom(b"\xa9nam", atom(b"data", struct.pack(">II", 1, 0) + b"Rain")))))), "Title: Rain"),
    "a.jpg": ("exif", exif(), "Camera make: Lumix\nGPS: N48.5000, E2.2500"),
    "a.zip": ("archive", zipped(b_dot_txt="", a_dot_txt=""), "a.txt\nb.txt"),
    "a.tgz": ("archive", tar(), "a/c.txt\nb.txt"),
}


@pytest.mark.parametrize("path", CASES)
def test_formats(path):
    name, data, want = CASES[path]
    mime, extractor, outcome, parts = x.extract(path, data)
    assert (extractor, outcome, "\n\n".join(t for t, _ in parts)) == (name, "extracted", want)


def test_refusals():
    assert x.extract("a.txt", b"a\0b")[2] == x.extract("a.bin", b"a")[2] == x.extract("a.docx", b"no zip")[2] == x.extract("a.txt", b" ")[2] == "skipped"
    assert x.mime_of("dir.x/A.TS") == "text/x-typescript" and x.mime_of("none") == ""


def test_files(spark, tmp_path):
    for path, (_, data, _) in CASES.items():
        (tmp_path / path).write_bytes(data)
    (tmp_path / "b.unknown").write_bytes(b"x")
    rows = x.extracted(x.read_files(spark, str(tmp_path))).collect()
    assert {r.path.rsplit("/", 1)[-1] for r in rows if r.outcome == "extracted"} == set(CASES)
    assert x.folder_bytes(spark, str(tmp_path)).first().files == len(CASES) + 1


def test_table_function_of_sql(spark):
    """Own extractors travel with the function; null files are skipped; texts come in chunks."""
    from siftwood.sources import table_function

    before = list(x.REGISTRY)
    table_function.register(spark, [("own", lambda mime, ext, size: ext == "own", lambda data: ["one", data.decode()])], "extract_own")
    spark.createDataFrame([(1, "a.own", b"two"), (2, "b.txt", b"plain"), (3, None, b"x"), (4, "c.own", None), (5, "d.bin", b"\0")], "id int, path string, content binary").createOrReplaceTempView("own_files")
    rows = spark.sql("select id, e.extractor, e.outcome, e.chunk_index, e.text from own_files f, lateral extract_own(f.path, f.content) e").collect()
    assert {tuple(r) for r in rows} == {(1, "own", "extracted", 0, "one"), (1, "own", "extracted", 1, "two"), (2, "plaintext", "extracted", 0, "plain"), (3, "", "skipped", None, None), (4, "", "skipped", None, None), (5, "", "skipped", None, None)}
    assert x.REGISTRY == before


def test_files_are_made_by_many_tasks(spark):
    rows = spark.range(100).coalesce(1).selectExpr("id", "'a' a", "'b' b", "'c' c")
    assert formats.files_of(rows, "odp").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def zim_file(clusters):
    """A ZIM file of plain articles: (compression, articles) by cluster."""
    packs = {1: bytes, 4: lzma.compress, 5: zstandard.compress, 9: bytes}
    bodies, entries = [], []
    for n, (kind, articles) in enumerate(clusters):
        ends = [4 * (len(articles) + 1)]
        for a in articles:
            ends.append(ends[-1] + len(a))
        bodies.append(bytes([kind]) + packs[kind](struct.pack(f"<{len(ends)}I", *ends) + b"".join(articles)))
        entries += [struct.pack("<HBBIII", 0, 0, ord("A"), 0, n, i) for i in range(len(articles))]
    types, at = b"text/plain\0\0", 92
    places = [at + 16 * i for i in range(len(entries))]
    urls = at + 16 * len(entries)
    starts = [urls + 8 * len(entries) + 8 * len(bodies)]
    for b in bodies:
        starts.append(starts[-1] + len(b))
    head = bytearray(80)
    head[:4] = b"ZIM\x04"
    struct.pack_into("<II", head, 24, len(entries), len(bodies))
    struct.pack_into("<QQQQ", head, 32, urls, 0, urls + 8 * len(entries), 80)
    return bytes(head) + types + b"".join(entries) + struct.pack(f"<{len(places)}Q", *places) + struct.pack(f"<{len(bodies)}Q", *starts[:-1]) + b"".join(bodies)


def test_zim_has_no_cap():
    """More articles than 5,000, more text than 32 MB, a cluster above 64 MB, in every compression; a cluster that can't be read costs its own articles only."""
    many, long = [b"article %d" % i for i in range(6000)], [b"a" * (33 << 20), b"b" * (34 << 20), b"behind"]
    data = zim_file([(1, many), (9, [b"unknown"]), (5, long), (4, [b"last"])])
    _, extractor, outcome, parts = x.extract("a.zim", data)
    want = [a.decode() for a in [*many, *long, b"last"]]
    assert (extractor, outcome, len(parts)) == ("zim", "extracted", len(want)) and [t for t, _ in parts] == want
    assert x.claimed("a.zim", 3 << 30)[1] == "zim"
