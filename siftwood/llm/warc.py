"""Deterministic sharded WARC files: range-sorted records, rolled by compressed size, committed by rename and manifest."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import arrow_rows, dealt_join, removed, saved, shared_dir, tidy

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 32 << 20
#: Payloads below this are never revisits.
LEAST_REVISIT = 100
#: Date that headers carry, as records are regenerated, not fetched.
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "siftwood:warc")
_NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path")


def _member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return _member(head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ':'.join(map(str, parts)))}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, again: int) -> bytes:
    """A response record, or a revisit if refers_to is given; `again` counts earlier records of page and payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = record_id(page_id, digest) if kind == "response" and not again else record_id(page_id, digest, kind, again)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    return _record(fields, http if refers_to is not None else http + payload)


def info_record(name: str) -> bytes:
    block = f"software: siftwood\r\nformat: {VERSION}\r\nfilename: {name}\r\n".encode()
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def marks(pages: DataFrame, work: str) -> DataFrame:
    """(page_id, digest, first) for pages whose payload, of LEAST_REVISIT bytes or more, occurs more than once.

    Payloads are hashed once, to a narrow table; a payload of many pages is dealt to several tasks.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("page_id").isNotNull() & (F.col("n") >= LEAST_REVISIT))
    narrow = saved(narrow.select("page_id", "digest"), work)
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    return dealt_join(narrow, groups, ["digest"], "c", narrow.count()).select("page_id", "digest", "first")


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) and return the manifest: path, n_records, n_bytes, sha256.

    Records come in order of page_id, then url and html; ids, dates and digests are regenerated from
    the row alone, so a run over the same rows and partitions gives the same bytes. Of equal
    payloads of LEAST_REVISIT bytes or more the first record of the smallest page_id is the
    response, also among repeated rows. Null html is empty, a null url has no target, rows of a null
    page_id are responses. Files appear under their names only when complete; the manifest, itself a
    committed table, lists the valid ones. Other columns are ignored.
    """
    arrow_rows(pages.sparkSession, 256)
    files.make_dir(folder)
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"))
    known = marks(pages, f"{folder}/_payloads").distinct().select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first")
    rows = rows.unionByName(known).repartitionByRange(F.col("page_id").asc_nulls_first()).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0
        page, first, seen = None, {}, {}

        def name() -> str:
            return f"pages-{part:06d}-{seq:06d}.warc.gz"

        def flush() -> pa.RecordBatch:
            data = b"".join(held)
            files.commit(f"{folder}/{name()}", data)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name()}"], "n_records": [n], "n_bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()]})

        for b in batches:
            for page_id, kind, url, html, digest, of in zip(*(b.column(c).to_pylist() for c in ("page_id", "kind", "url", "html", "digest", "first")), strict=True):
                if page_id != page:
                    page, first, seen = page_id, {}, {}
                if kind == 0:
                    first[digest] = of
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                again = seen.get(digest, 0)
                seen[digest] = again + 1
                refers = first.get(digest) if page_id is not None and len(payload) >= LEAST_REVISIT else None
                if refers == page_id and not again:
                    refers = None
                if not held:
                    held.append(info_record(name()))
                    size = len(held[0])
                held.append(page_record(page_id, url, payload, digest, refers, again))
                size, n = size + len(held[-1]), n + 1
                if size >= roll_bytes:
                    yield flush()
                    seq, held, size, n = seq + 1, [], 0, 0
        if held:
            yield flush()

    manifest = saved(rows.mapInArrow(tidy(run), "path string, n_records long, n_bytes long, sha256 string"), f"{folder}/_manifest")
    removed(pages.sparkSession, f"{folder}/_payloads")
    return manifest


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record; raises ValueError if its digest or length is wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != VERSION or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("damaged WARC record")
    return fields, block


def read_warc(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, data = [], files.read(path)
                view = memoryview(data)
                at = 0
                while at < len(data):
                    z = zlib.decompressobj(31)
                    text, i = [], at
                    while not z.eof:
                        if i >= len(data):
                            raise ValueError("cut WARC file")
                        text.append(z.decompress(view[i : i + (1 << 16)]))
                        i += len(view[i : i + (1 << 16)])
                    at = i - len(z.unused_data)
                    fields, block = parsed(b"".join(text))
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError("damaged payload")
                    number = lambda k: int(fields[k]) if k in fields else None
                    url = fields.get("WARC-Target-URI")
                    url = url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
                    rows.append((number("X-Page-ID"), length, digest, fields["WARC-Type"], number("X-Refers-To-Page"), url, path))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(_NAMES))

    return manifest.select("path").repartition(files.readers(manifest.count()), "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string")


def archive(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages into a fresh shared folder and return what is read back."""
    return read_warc(write_warc(pages, shared_dir(pages.sparkSession) + "/warc", roll_bytes))
