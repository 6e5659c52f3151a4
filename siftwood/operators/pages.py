"""One paged tree of any number of records, packed and written by many tasks.

Pages fill up greedily: an item opens a page if it doesn't fit into the one before. Which items do depends on all items
before them, but only through the bytes that are used in the page that is open at the start of a part, and these decide no more than
which of its first items opens a page. So each part of the sorted items says, for each of those, how many pages
it opens and what it leaves used; these short tables are put together in order, and then each part knows its
pages. Levels above are packed the same way from the first keys of the pages below.

Records are kept once, sorted, in their columns, until their leaves are written: a file of leaves begins where one of its pages opens,
so its task needs no more than the place of that record and reads on from there. Neither encoded records nor pages are shuffled.

Pages lie in files of FILE_PAGES pages, compressed FRAME at a time, named by a manifest, root first, leaves and trailer last. The fingerprint is a Merkle
root: a leaf's digest is that of its records, an interior page's that of the digests below it.
"""

from __future__ import annotations

import gc
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import ed25519
from siftwood.operators.records import _TRAILER, HEADER, INTERIOR, LEAF, MAX_RECORD, ROOT, TRAILER, in_order, page, uvarint, well_formed
from siftwood.session import work_dir

#: Pages of a file; version of trailers whose fingerprint is a Merkle root.
FILE_PAGES, MERKLE_VERSION = 2048, 2
#: Pages that are compressed together; steps in which leaves are written, behind each of which the records that are on pages go; rows that are read at once.
FRAME, STEPS, ROWS = 8, 8, 4096
#: How sorted records are stored: an infohash is one of its documents' for many keywords, so a dictionary of them pays.
STORED = {"compression": "zstd", "parquet.block.size": 64 << 20, "parquet.dictionary.page.size": 16 << 20}
_FRAMES = [uvarint(n) for n in range(MAX_RECORD + 1)]


def capacity(page_size: int) -> int:
    """Bytes of a page for its items, behind the header and their number."""
    return min(page_size - HEADER, 65535) - 2


def chains(sizes: np.ndarray, room: int) -> tuple[list[int], list[int], list[int]]:
    """(before, pages, used) for the items that may be the first to open a page: bytes of the part before it, pages opened from it on, bytes used in the last of them."""
    if len(sizes) and sizes.max() > room:
        raise ValueError("item larger than a page")
    total = np.concatenate([[0], np.cumsum(sizes)])
    after = (np.searchsorted(total, total[:-1] + room, "right") - 1).tolist()
    n = len(sizes)
    pages, used = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = after[i]
        pages[i], used[i] = (1, int(total[n] - total[i])) if j == n else (pages[j] + 1, used[j])
    last = min(n, int(np.searchsorted(total, room, "right")))
    return total[: last + 1].tolist(), pages[:last], used[:last]


def _entries(items: DataFrame, room: int) -> tuple[dict[int, tuple[int, int]], int]:
    """({part: (its first item that opens a page, the number of that page)}, pages in all) for items(part, place, size)."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        sizes = f.sort_values("place")["size"].to_numpy()
        before, pages, used = chains(sizes, room)
        return pd.DataFrame({"part": [key[0]], "n": [len(sizes)], "total": [int(sizes.sum())], "before": [before], "pages": [pages], "used": [used]})

    tables = items.select("part", "place", "size").groupBy("part").applyInPandas(run, "part int, n long, total long, before array<long>, pages array<long>, used array<long>")
    out, number, used = {}, 0, room + 1  # no page is open, so the first item opens one
    for t in tables.orderBy("part").collect():  # a page's worth of numbers for each part
        j = next((k for k in range(len(t.pages)) if used + t.before[k + 1] > room), None) if len(t.before) > len(t.pages) else None
        if j is None:
            out[t.part] = (t.n, number)
            used += t.total
            continue
        out[t.part] = (j, number)
        number, used = number + t.pages[j], t.used[j]
    return out, number


def _numbered(items: DataFrame, entries: dict[int, tuple[int, int]], room: int) -> DataFrame:
    """items with the number of their page and whether they open it."""
    sent = items.sparkSession.sparkContext.broadcast(entries)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, index, number, used = None, 0, 0, 0
        for f in frames:
            numbers, opens = [], []
            for p, size in zip(f["part"].tolist(), f["size"].tolist(), strict=True):
                if p != part:
                    part, index = p, 0
                    first, number = sent.value[p]
                    number, used = number - 1, 0
                new = index == first or index > first and used + size > room
                if new:
                    number, used = number + 1, 0
                used, index = used + size, index + 1
                numbers.append(number)
                opens.append(new)
            yield f.assign(page=numbers, opens=opens)

    rows = items.repartition("part").sortWithinPartitions("part", "place")
    return rows.mapInPandas(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in items.schema.fields) + ", page long, opens boolean")


def _placed(items: DataFrame, entries: dict[int, tuple[int, int]], opening: DataFrame) -> DataFrame:
    """items with the number of their page, from the places (at_part, at_place) where pages open: rows are neither shuffled nor sorted.

    Tasks get two numbers for each page, which are to its records as 16 bytes are to 16 KiB.
    """
    at = opening.select("at_part", "at_place").toPandas().sort_values(["at_part", "at_place"])
    opens = {int(p): f.to_numpy() for p, f in at.groupby("at_part")["at_place"]}
    sent = items.sparkSession.sparkContext.broadcast({p: (number, opens.get(p, np.zeros(0, np.int64))) for p, (_, number) in entries.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts, place, numbers = f["part"].to_numpy(), f["place"].to_numpy(), np.zeros(len(f), np.int64)
            for p in np.unique(parts):
                number, places = sent.value[int(p)]
                on = parts == p
                numbers[on] = number - 1 + np.searchsorted(places, place[on], "right")
            yield f.assign(page=numbers)

    return items.mapInPandas(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in items.schema.fields) + ", page long")


def packed(pages: list[bytes]) -> bytes:
    """A file of pages: compressed frames of FRAME pages, the ends of the frames, and how many frames and pages of a frame there are."""
    frames = [zstandard.compress(b"".join(pages[i : i + FRAME])) for i in range(0, len(pages), FRAME)]
    return b"".join(frames) + struct.pack(f"<{len(frames)}QII", *np.cumsum([len(x) for x in frames]).tolist(), len(frames), FRAME)


def _commit(folder: str, name: str, data: bytes) -> None:
    """A file under a temporary name, then moved to its place."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    system.move(temporary, f"{path}/{name}")


def _written(numbered: DataFrame, folder: str, kind: int, level: int, start: int, page_size: int) -> DataFrame:
    """Write the pages of a level above the leaves from numbered(part, place, page, key, code, digest): rows (page, key, digest, path, first, n), path only at the first page of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, pages, rows, codes, digests, at, key = None, [], [], [], [], None, None

        def close_page() -> None:
            nonlocal codes, digests
            if codes:
                digest = hashlib.sha256(b"".join(digests)).digest()
                pages.append(page(kind, level, struct.pack("<H", len(codes)) + b"".join(codes), page_size))
                rows.append((at, key, digest))
                codes, digests = [], []

        def close_file() -> pd.DataFrame:
            name = f"pages-{start + file * FILE_PAGES:012d}"
            _commit(folder, name, packed(pages))
            out = pd.DataFrame(rows, columns=["page", "key", "digest"]).assign(path=None, first=start + file * FILE_PAGES, n=len(pages))
            out.loc[0, "path"] = name
            return out

        for f in frames:
            for number, k, code, digest in zip(f["page"].tolist(), f["key"], f["code"], f["digest"], strict=True):
                if number != at:
                    close_page()
                    if number // FILE_PAGES != file:
                        if pages:
                            yield close_file()
                        file, pages, rows = number // FILE_PAGES, [], []
                    at, key = number, bytes(k)
                codes.append(bytes(code))
                digests.append(bytes(digest))
        close_page()
        if pages:
            yield close_file()

    rows = numbered.withColumn("file", F.floor(F.col("page") / FILE_PAGES)).repartition("file").sortWithinPartitions("page", "part", "place")
    return rows.select("page", "key", "code", "digest").mapInPandas(run, _ROWS)


#: Rows that a level's writer returns.
_ROWS = "page long, key binary, digest binary, path string, first long, n long"
_ROW = 1 << 33  # places of a task in monotonically_increasing_id()


def _sized(stored: DataFrame) -> DataFrame:
    """(part, place, size) of stored records: the bytes of each in a page, from its lengths alone."""
    text = F.octet_length("kw")
    n = F.lit(157) + text + F.length(text.cast("string")) + F.length(F.conv(F.hex("pow"), 16, 10)) + F.length(F.col("t").cast("string"))
    n = F.when(n <= MAX_RECORD, n).otherwise(F.raise_error(F.lit("record length")).cast("int"))  # also where time or proof are unknown
    return stored.select(F.floor(F.col("at") / _ROW).cast("int").alias("part"), (F.col("at") % _ROW).alias("place"), (n + F.when(n > 127, 2).otherwise(1)).cast("int").alias("size"))


def _file_starts(sized: DataFrame, entries: dict[int, tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(page, at) of the pages that begin a file, with the record that opens each."""
    sent, every = sized.sparkSession.sparkContext.broadcast(entries), FILE_PAGES

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = np.concatenate([[0], np.cumsum(f.sort_values("place")["size"].to_numpy())])
        after = np.searchsorted(total, total[:-1] + room, "right") - 1
        part, out = int(key[0]), []
        i, number = sent.value[part]
        while i < len(after):
            if number % every == 0:
                out.append((number, part * _ROW + i))
            i, number = int(after[i]), number + 1
        return pd.DataFrame(out, columns=["page", "at"], dtype="int64")

    return sorted(map(tuple, sized.groupBy("part").applyInPandas(run, "page long, at long").collect()))


def _stored_rows(path: str, start: int, stop: int) -> Iterator[tuple]:
    """Rows start to stop of a file of records, as (ih, kw, pk, pow, sig, t); row groups outside are not read."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        file, at = pq.ParquetFile(f), 0
        for g in range(file.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            if at < stop and at + n > start:
                low = at
                for b in file.iter_batches(ROWS, row_groups=[g], columns=["ih", "kw", "pk", "pow", "sig", "t"]):
                    if low >= stop:
                        return
                    own = b.slice(max(0, start - low), max(0, min(stop, low + len(b)) - max(start, low)))
                    low += len(b)
                    yield from zip(*(own.column(c).cast(pa.binary()).to_pylist() if c == "kw" else own.column(c).to_pylist() for c in ("ih", "kw", "pk", "pow", "sig", "t")), strict=True)
            at += n


def _leaves(units: DataFrame, folder: str, page_size: int) -> DataFrame:
    """Write a file of leaves, named by its first leaf, for each unit (first, n, ranges of stored records): rows as _written() has them."""
    room = capacity(page_size)

    def made(unit: dict) -> pa.RecordBatch:
        pages, keys, digests, codes, used = [], [], [], [], room + 1

        def close() -> None:
            if codes:
                digests.append(hashlib.sha256(b"".join(codes)).digest())
                pages.append(page(LEAF, 0, struct.pack("<H", len(codes)) + b"".join([_FRAMES[len(c)] + c for c in codes]), page_size))
                codes.clear()

        for r in unit["ranges"]:
            for ih, kw, pk, pow_, sig, t in _stored_rows(r["path"], r["start"], r["stop"]):
                code = b"d2:ih20:%b2:kw%d:%b2:pk32:%b3:powi%de3:sig64:%b1:ti%dee" % (ih, len(kw), kw, pk, pow_ % (1 << 64), sig, t)
                size = len(code) + len(_FRAMES[len(code)])
                if used + size > room:
                    close()
                    keys.append(kw + b"\0" + ih)
                    used = 0
                codes.append(code)
                used += size
        close()
        if len(pages) != unit["n"]:
            raise ValueError(f"{len(pages)} leaves from {unit['first']} on where {unit['n']} were planned")
        name, n = f"leaves-{unit['first']:012d}", len(pages)
        _commit(folder, name, packed(pages))
        columns = [range(unit["first"], unit["first"] + n), keys, digests, [name] + [None] * (n - 1), [unit["first"]] * n, [n] * n]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page", "key", "digest", "path", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from map(made, b.to_pylist())

    return units.mapInArrow(run, _ROWS)


def _files(stored: DataFrame) -> list[tuple[int, int, str]]:
    """(first at, rows, path) of the files of stored records, in order."""
    return sorted(map(tuple, stored.groupBy(F.input_file_name().alias("path")).agg(F.min("at").alias("first"), F.count("*").alias("n")).select("first", "n", "path").collect()))


def _units(files: list[tuple[int, int, str]], starts: list[tuple[int, int]], n: int) -> list[tuple]:
    """(first leaf, leaves, files and rows of their records) for each file of leaves."""
    firsts, out = [x[0] for x in files], []
    for k, (number, low) in enumerate(starts):
        last, high = starts[k + 1] if k + 1 < len(starts) else (n, firsts[-1] + files[-1][1])
        own = files[max(0, int(np.searchsorted(firsts, low, "right")) - 1) : int(np.searchsorted(firsts, high, "left"))]
        out.append((number, last - number, [(path, max(0, low - first), min(rows, high - first)) for first, rows, path in own if low < first + rows]))
    return out


def _leaf_level(stored: DataFrame, starts: list[tuple[int, int]], n: int, folder: str, work: str, page_size: int) -> tuple[DataFrame, int]:
    """Write all leaves, step by step; a file of records is deleted when the leaves of all its records are written. Returns the rows of _leaves() and the number of records."""
    spark = stored.sparkSession
    files = _files(stored)
    units, left = _units(files, starts, n), [x[2] for x in files]
    step = max(2 * spark.sparkContext.defaultParallelism, -(-len(units) // STEPS))
    kind, paths = "first long, n long, ranges array<struct<path:string,start:long,stop:long>>", []
    for i in range(0, len(units), step):
        own = units[i : i + step]
        paths.append(f"{work}/level0-{i:08d}")
        rows = _saved(_leaves(spark.createDataFrame(own, kind).repartition(len(own)), folder, page_size), paths[-1])
        needed = units[i + step][2][0][0] if i + step < len(units) else None
        while left and left[0] != needed:
            _dropped(spark, left.pop(0))
    return spark.read.schema(rows.schema).parquet(*paths), sum(x[1] for x in files)


def _behind_length(code: bytes) -> bytes:
    at = 0
    while code[at] & 0x80:
        at += 1
    return code[at + 1 :]


def _saved(df: DataFrame, path: str, **options) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tree(records: DataFrame, folder: str, seed: bytes, seq: int = 1, created: int = 0, page_size: int = 16 << 10, min_bits: int = 0) -> dict:
    """Write the paged tree of well-formed records below folder, which executors share; returns the trailer's facts.

    Page boundaries are those of packing all records one after another. Nothing but a page's worth of numbers for each part of the sorted
    records, the place of each file's first record, the manifest and the root's digest reach the driver. Records of unknown time, and an
    empty table, raise an error. Disk holds the sorted records and first their shuffle, then the tree.
    """
    spark, work, room = records.sparkSession, work_dir(records.sparkSession), capacity(page_size)
    rows = in_order(well_formed(records)).select("pk", "kw", "ih", "t", "pow", "sig").withColumn("at", F.monotonically_increasing_id())
    stored = _saved(rows, f"{work}/records", **STORED)
    _released(spark)
    sized = _sized(stored)
    entries, n = _entries(sized, room)
    if not n:
        raise ValueError("no records")
    plans: list[tuple] = [(None, None, n)]
    opens = _file_starts(sized, entries, room)
    _released(spark)
    leaves, count = _leaf_level(stored, opens, n, folder, work, page_size)
    below = lambda rows: rows.select((F.col("page") / 65536).cast("int").alias("part"), F.col("page").alias("place"), _key_bytes(F.octet_length("key")).alias("size"), "key")
    level_items = below(leaves)
    while plans[-1][2] > 1 or len(plans) < 2:
        entries, n = _entries(level_items, room)
        plans.append((level_items, entries, n))
        level_items = _saved(below(_numbered(level_items, entries, room).filter("opens")), f"{work}/keys{len(plans)}")
    starts = np.cumsum([0] + [n for *_, n in plans[:0:-1]]).tolist()[::-1]  # of the levels from the leaves up
    system, path = fs.FileSystem.from_uri(folder)
    for r in leaves.filter("path is not null").select("path", "first").collect():
        system.move(f"{path}/{r.path}", f"{path}/pages-{starts[0] + r['first']:012d}")
    first = F.col("first") + starts[0]
    digests = leaves
    manifest = leaves.filter("path is not null").select(F.lit(0).alias("level"), F.format_string("pages-%012d", first).alias("path"), first.alias("first"), "n", "key")
    for level, (these, entries, _) in enumerate(plans[1:], 1):
        child = F.col("place") + starts[level - 1]
        number = F.unhex(F.concat(*[F.substring(F.lpad(F.hex(child), 8, "0"), 7 - 2 * i, 2) for i in range(4)]))
        these = these.join(digests.select(F.col("page").alias("place"), "digest"), "place").withColumn("code", F.concat(_varint(F.octet_length("key")), "key", number))
        numbered = _numbered(these.select("part", "place", "size", "key", "code", "digest"), entries, room)
        made = _written(numbered, folder, ROOT if level == len(plans) - 1 else INTERIOR, level, starts[level], page_size)
        digests = _saved(made, f"{work}/level{level}")
        manifest = manifest.unionByName(digests.filter("path is not null").select(F.lit(level).alias("level"), "path", "first", "n", "key"))
    root, pages = bytes(digests.first().digest), sum(n for *_, n in plans) + 1
    fields = _TRAILER.pack(MERKLE_VERSION, ed25519.public_key(seed), seq, created, 0, pages, count, min_bits, root)
    _commit(folder, f"pages-{pages - 1:012d}", packed([page(TRAILER, 0, fields + ed25519.sign(seed, fields), page_size)]))
    manifest.write.parquet(f"{folder}/_manifest")
    _dropped(spark, work)
    return {"pages": pages, "records": count, "levels": [n for *_, n in plans], "fingerprint": root.hex()}


def _released(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that the shuffle files of ended steps go before the next step writes its own."""
    gc.collect()
    spark._jvm.System.gc()


def _dropped(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _key_bytes(length):
    """Bytes of a framed key of that length with its page number (keys are shorter than 128 bytes)."""
    return (length + 5).cast("int")


def _varint(length):
    return F.unhex(F.lpad(F.hex(length.cast("long")), 2, "0"))


def leaf_table(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a written tree: level, path, first page, pages, first key."""
    return spark.read.parquet(f"{folder}/_manifest")
