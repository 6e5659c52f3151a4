"""A Spark data source over paged trees: partitions are runs of leaf pages, prefix filters choose them.

    spark.dataSource.register(PagedRecords)
    spark.read.format("paged_records").load(folder).filter(F.col("kw").startswith("ab"))

A prefix costs two descents from the root, each reading one page a level; then only leaves between the two
ends are read. Without a prefix all leaves are.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from siftwood.functions import ed25519
from siftwood.functions.text import next_prefix
from siftwood.operators.pages import MERKLE_VERSION
from siftwood.operators.records import _TRAILER, LEAF, TRAILER, _items, decoded, message, opened, zero_bits

#: Leaf pages of an input partition.
RUN_PAGES = 256
SCHEMA = "pk binary, kw string, ih binary, t bigint, pow bigint, sig binary, page bigint"


class Pages:
    """Pages of a tree by number, from the files that hold them."""

    def __init__(self, folder: str, page_size: int):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.size, self.reads, self.ends = page_size, 0, {}
        names = [x.base_name for x in self.system.get_file_info(fs.FileSelector(self.path)) if x.base_name.startswith("pages-")]
        self.first = sorted(int(n.removeprefix("pages-")) for n in names)
        if not self.first:
            raise ValueError("no pages")

    def read(self, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """(number, page) of the pages from start to stop - 1."""
        while start < stop:
            k = bisect_right(self.first, start) - 1
            end = min(stop, self.first[k + 1] if k + 1 < len(self.first) else stop)
            with self.system.open_input_file(f"{self.path}/pages-{self.first[k]:012d}") as f:
                ends, per = self.ends.get(k) or self.frames(f, k)
                while start < end:
                    j, skip = divmod(start - self.first[k], per)
                    f.seek(ends[j - 1] if j else 0)
                    data = zstandard.decompress(f.read(ends[j] - (ends[j - 1] if j else 0)))
                    for i in range(start, min(end, start - skip + per)):
                        self.reads += 1
                        yield i, data[skip * self.size : (skip + 1) * self.size]
                        skip += 1
                    start = i + 1

    def frames(self, f, k: int) -> tuple[tuple[int, ...], int]:
        """The ends of a file's compressed frames, and the pages of a frame."""
        size = f.size()
        f.seek(size - 8)
        n, per = struct.unpack("<II", f.read(8))
        f.seek(size - 8 - 8 * n)
        self.ends[k] = struct.unpack(f"<{n}Q", f.read(8 * n)), per
        return self.ends[k]

    def one(self, i: int) -> bytes:
        return next(self.read(i, i + 1))[1]

    def trailer(self) -> dict:
        """The checked facts of the last page."""
        kind, _, payload = opened(self.one(self.first[-1]))
        names = ("version", "pk", "seq", "created", "root", "pages", "records", "min_bits", "fingerprint")
        out = dict(zip(names, _TRAILER.unpack(payload[: _TRAILER.size]), strict=True))
        if kind != TRAILER or out["version"] != MERKLE_VERSION or out["pages"] != self.first[-1] + 1 or not ed25519.verify(out["pk"], payload[: _TRAILER.size], payload[_TRAILER.size :]):
            raise ValueError("bad trailer")
        return out

    def leaf(self, bound: bytes | None) -> int:
        """The leaf where a bound would lie, the last that begins below it: keys from the bound on begin there, or keys below it end there (None: the last leaf)."""
        i = 0
        while True:
            kind, _, payload = opened(self.one(i))
            if kind == LEAF:
                return i
            below = _items(payload, 4)
            j = len(below) - 1 if bound is None else max(0, sum(k < bound for k, _ in below) - 1)
            i = struct.unpack("<I", below[j][1])[0]

    def overlap(self, prefix: str) -> tuple[int, int]:
        """Leaves [start, stop) that may hold keywords with the prefix."""
        low = prefix.encode()
        return self.leaf(low), self.leaf(next_prefix(low) if low else None) + 1


class Run(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.page_size = options["path"], int(options.get("pageSize", 16 << 10))
        self.verify = options.get("verify", "false").lower() == "true"
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Prefixes of the keyword, and equality with one, choose pages; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, StringStartsWith | EqualTo) and tuple(f.attribute) == ("kw",) and isinstance(f.value, str) and len(f.value) > len(self.prefix):
                self.prefix = f.value
            yield f

    def partitions(self) -> list[Run]:
        start, stop = Pages(self.folder, self.page_size).overlap(self.prefix)
        return [Run(i, min(stop, i + RUN_PAGES)) for i in range(start, stop, RUN_PAGES)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        pages, low = Pages(self.folder, self.page_size), self.prefix.encode()
        bits = pages.trailer()["min_bits"] if self.verify else 0
        kinds = [("pk", pa.binary()), ("kw", pa.string()), ("ih", pa.binary()), ("t", pa.int64()), ("pow", pa.int64()), ("sig", pa.binary()), ("page", pa.int64())]
        for i, data in pages.read(partition.start, partition.stop):
            rows = []
            for code, _ in _items(opened(data)[2], 0):
                r = decoded(code)
                if r[1].encode().startswith(low):
                    m = message(*r[:5])
                    if not self.verify or zero_bits(hashlib.sha256(m).digest()) >= bits and ed25519.verify(r[0], m, r[5]):
                        rows.append((*r, i))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))


class PagedRecords(DataSource):
    """Format paged_records. Options: path, pageSize, verify (drop records of bad signatures or too little proof of work)."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_tree(spark: SparkSession, folder: str, page_size: int = 16 << 10, verify: bool = False):
    """The records of a tree, with the page of each; filters on prefixes of kw are pushed to the pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRecords)
    return spark.read.format("paged_records").option("pageSize", page_size).option("verify", str(verify).lower()).load(folder)
