"""Queries of the file extractors: files of every format are made from the rows of part and read back."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.session import spread, table
from siftwood.sources import extractors, table_function


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _tar(names: list[str]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n in names:
            t.addfile(tarfile.TarInfo(n), io.BytesIO())
    return gzip.compress(out.getvalue(), 1)


def _office(tag: str, paragraphs: list[str], inner: str = "") -> str:
    open_, close = (f"<{inner}>", f"</{inner}>") if inner else ("", "")
    return f'<x:doc xmlns:x="urn:x">{"".join(f"<{tag}>{open_}{p}{close}</{tag}>" for p in paragraphs)}</x:doc>'


def _comments(*pairs: str) -> bytes:
    rows = [p.encode() for p in pairs]
    return struct.pack("<I", 1) + b"v" + struct.pack("<I", len(rows)) + b"".join(struct.pack("<I", len(p)) + p for p in rows)


def _pdf(lines: list[str]) -> bytes:
    text = " T* ".join(f"({x}) Tj" for x in lines)
    return b"%PDF-1.4\n1 0 obj<</Filter/FlateDecode>>stream\n" + zlib.compress(f"BT {text} ET".encode()) + b"\nendstream"


def _id3(frames: dict[str, bytes]) -> bytes:
    body = b"".join(k.encode() + struct.pack(">I", len(v) + 1) + b"\0\0\3" + v for k, v in frames.items())
    n = len(body)
    return b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def _mobi(title: str, author: str) -> bytes:
    records = struct.pack(">II", 100, 8 + len(author)) + author.encode()
    exth = b"EXTH" + struct.pack(">II", 12 + len(records), 1) + records
    size, start = 232, 100
    head = bytearray(16 + size)
    head[16:20] = b"MOBI"
    struct.pack_into(">III", head, 20, size, 2, 65001)
    struct.pack_into(">II", head, 84, len(head) + len(exth), len(title.encode()))
    front = bytearray(start)
    front[60:68] = b"BOOKMOBI"
    struct.pack_into(">I", front, 78, start)
    return bytes(front + head) + exth + title.encode()


def _ebml(kind: str, body: bytes) -> bytes:
    return bytes.fromhex(kind) + (0x4000 | len(body)).to_bytes(2, "big") + body


def _atom(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def _item(kind: bytes, text: str) -> bytes:
    return _atom(kind, _atom(b"data", struct.pack(">II", 1, 0) + text.encode()))


def _jpeg(make: str) -> bytes:
    text = make.encode() + b"\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x010F, 2, len(text), 40)
    body = b"Exif\0\0" + tiff.ljust(40, b"\0") + text
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def _zim(articles: list[str]) -> bytes:
    """One cluster without compression, a list of types, an entry for each article."""
    types = b"text/html\0\0"
    at = 80 + len(types)
    entries = [struct.pack("<HBBIII", 0, 0, ord("A"), 0, 0, i) + f"u{i}\0t{i}\0".encode() for i in range(len(articles))]
    places = [at + sum(map(len, entries[:i])) for i in range(len(entries))]
    urls = at + sum(map(len, entries))
    clusters = urls + 8 * len(entries)
    blobs = [f"<p>{x}</p>".encode() for x in articles]
    ends = [4 * (len(blobs) + 1) + sum(map(len, blobs[:i])) for i in range(len(blobs) + 1)]
    cluster = b"\1" + struct.pack(f"<{len(ends)}I", *ends) + b"".join(blobs)
    head = bytearray(80)
    head[:4] = b"ZIM\x04"
    struct.pack_into("<II", head, 24, len(articles), 1)
    struct.pack_into("<QQQQ", head, 32, urls, 0, clusters, 80)
    return bytes(head) + types + b"".join(entries) + struct.pack(f"<{len(places)}Q", *places) + struct.pack("<Q", clusters + 8) + cluster


#: By extension: the extractor, a file of name, type and brand, and the SQL of its text.
FORMATS: dict[str, tuple[str, Callable[[str, str, str], bytes], str]] = {
    "txt": ("plaintext", lambda a, b, c: f"{a}\n{b}".encode(), "a || chr(10) || b"),
    "srt": ("subtitle", lambda a, b, c: f"1\n00:00:01,000 --> 00:00:02,000\n<i>{a}</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n{b}\n".encode(), "a || chr(10) || b"),
    "epub": ("epub", lambda a, b, c: _zip({"b.xhtml": f"<p>{b}</p>", "a.html": f"<title>{a}</title>", "META-INF/x.html": "<p>no</p>"}), "a || chr(10) || chr(10) || b"),
    "docx": ("docx", lambda a, b, c: _zip({"word/document.xml": _office("x:p", [a, b], "x:t")}), "a || chr(10) || chr(10) || b"),
    "odt": ("odt", lambda a, b, c: _zip({"content.xml": _office("x:p", [a, b])}), "a || chr(10) || chr(10) || b"),
    "odp": ("odp", lambda a, b, c: _zip({"content.xml": _office("x:h", [c, a])}), "c || chr(10) || chr(10) || a"),
    "pptx": ("pptx", lambda a, b, c: _zip({"ppt/slides/slide10.xml": _office("x:p", [b], "x:t"), "ppt/slides/slide2.xml": _office("x:p", [a], "x:t")}), "a || chr(10) || chr(10) || b"),
    "pdf": ("pdf", lambda a, b, c: _pdf([a, b]), "a || chr(10) || b"),
    "rtf": ("rtf", lambda a, b, c: rf"{{\rtf1{{\fonttbl no;}}{a}\par {b}}}".encode(), "a || chr(10) || b"),
    "fb2": ("fb2", lambda a, b, c: f"<f><binary>no</binary><section><title><p>{a}</p></title><p>{b}</p></section></f>".encode(), "a || chr(10) || chr(10) || b"),
    "mobi": ("mobi", lambda a, b, c: _mobi(a, b), "'Title: ' || a || chr(10) || 'Author: ' || b"),
    "mp3": ("id3", lambda a, b, c: _id3({"TIT2": a.encode(), "TPE1": b.encode()}), "'Title: ' || a || chr(10) || 'Artist: ' || b"),
    "flac": ("flac", lambda a, b, c: b"fLaC\x84" + len(_comments(f"TITLE={a}", f"ARTIST={b}")).to_bytes(3, "big") + _comments(f"TITLE={a}", f"ARTIST={b}"), "'Title: ' || a || chr(10) || 'Artist: ' || b"),
    "ogg": ("ogg", lambda a, b, c: b"OggS" + bytes(22) + bytes([1, len(b"OpusTags" + _comments(f"title={a}"))]) + b"OpusTags" + _comments(f"title={a}"), "'Title: ' || a"),
    "mkv": ("mkv", lambda a, b, c: bytes.fromhex("1a45dfa3") + b"\x80" + _ebml("18538067", _ebml("1549a966", _ebml("7ba9", a.encode()))), "'Title: ' || a"),
    "mp4": ("mp4", lambda a, b, c: _atom(b"ftyp", b"isom") + _atom(b"moov", _atom(b"udta", _atom(b"meta", bytes(4) + _atom(b"ilst", _item(b"\xa9nam", a) + _item(b"\xa9ART", b))))), "'Title: ' || a || chr(10) || 'Artist: ' || b"),
    "jpg": ("exif", lambda a, b, c: _jpeg(a), "'Camera make: ' || a"),
    "zip": ("archive", lambda a, b, c: _zip({f"{a}.txt": "", f"{a}/{b}.txt": ""}), "a || '.txt' || chr(10) || a || '/' || b || '.txt'"),
    "tgz": ("archive", lambda a, b, c: _tar([f"b/{b}", f"a/{a}"]), "'a/' || a || chr(10) || 'b/' || b"),
    "zim": ("zim", lambda a, b, c: _zim([a, b]), "a || chr(10) || chr(10) || b"),
}


def files_of(rows: DataFrame, ext: str) -> DataFrame:
    """rows(id, a, b, c) as files of a format: path, length, content; made by many tasks, however few bytes the rows are."""
    make = FORMATS[ext][1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = [make(a, b, c) for a, b, c in zip(f.a, f.b, f.c, strict=True)]
            yield pd.DataFrame({"path": [f"/files/{i}.{ext}" for i in f.id], "length": [len(x) for x in data], "content": data})

    return spread(rows).mapInPandas(run, "path string, length long, content binary")


def _query(ext: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_type").alias("b"), F.col("p_brand").alias("c"))
        out = extractors.extracted(files_of(rows, ext))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x.text), "\n\n")
        return out.groupBy("path", "extractor", "outcome").agg(text.alias("text"))

    return run


def _fields(data: bytes) -> str:
    """The text of a file of name=value lines."""
    return data.decode().replace("=", ": ")


def extract_lateral(spark: SparkSession, d: str) -> DataFrame:
    """Files of two formats that are made known at run time, and of one that nobody knows, through the table function of SQL."""
    more = [("fields", lambda mime, ext, size: ext == "fields", _fields), ("shout", lambda mime, ext, size: ext == "shout", lambda data: data.decode().upper())]
    table_function.register(spark, more)
    kind = F.element_at(F.array(F.lit("fields"), F.lit("shout"), F.lit("unknown")), (F.col("p_partkey") % 3 + 1).cast("int"))
    content = F.when(kind == "fields", F.concat(F.lit("name="), "p_name", F.lit("\ntype="), "p_type")).otherwise(F.col("p_name")).cast("binary")
    spread(table(spark, d, "part")).select(F.col("p_partkey").alias("id"), F.concat(F.lit("/files/"), F.col("p_partkey").cast("string"), F.lit("."), kind).alias("path"), content.alias("content")).createOrReplaceTempView("siftwood_files")
    return spark.sql("select f.id, e.extractor, e.outcome, e.text from siftwood_files f, lateral extract_file(f.path, f.content) e")


LATERAL_SQL = """
select p_partkey id, case p_partkey % 3 when 0 then 'fields' when 1 then 'shout' else '' end extractor, case p_partkey % 3 when 2 then 'skipped' else 'extracted' end outcome,
  case p_partkey % 3 when 0 then 'name: ' || p_name || chr(10) || 'type: ' || p_type when 1 then upper(p_name) end as text from part"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"extract_{ext}": _query(ext) for ext in FORMATS} | {"extract_lateral": extract_lateral}


def oracles() -> dict[str, str]:
    rows = "(select p_partkey id, p_name a, p_type b, p_brand c from part)"
    return {f"extract_{ext}": f"select '/files/' || id || '.{ext}' as path, '{name}' extractor, 'extracted' outcome, {text} as text from {rows}" for ext, (name, _, text) in FORMATS.items()} | {"extract_lateral": LATERAL_SQL}
