"""Work tables in the shared folder, word hashing, packed arrays and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to Python; whole texts can be long, so batches stay short.
ARROW_ROWS = 1024


@lru_cache(1)
def _local_dir(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="siftwood-")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and all runs in one process (tests) a temporary folder takes its
    place; a cluster without the setting raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_dir(spark.sparkContext.master)
    return f"{base.rstrip('/')}/siftwood-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str, **options) -> DataFrame:
    """Write df as Parquet below a shared folder and read it again, which cuts its lineage."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that its heap shrinks and the shuffle files and broadcasts of ended steps go; for rounds of many jobs."""
    gc.collect()  # Python's references to plans and broadcasts
    spark._jvm.System.gc()


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches short enough for whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(1)
def _trim():
    """Return free heap pages to the system, where the C library can."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda: None
    return lambda: trim(0)


def trim() -> None:
    """Give free memory of this worker back."""
    pa.default_memory_pool().release_unused()
    _trim()()


def tidy(run):
    """A mapInArrow function after which the worker gives its memory back, as idle workers live on beside the next stage's."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return go


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (an xor-multiply finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_MULTIPLIER = 0x9FB21C651E98DF25  # odd, so that it has an inverse modulo 2**64
_SPREAD = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 20


class WordHashes:
    """64-bit hashes of the lower-case (A-Z) words between ASCII white space, for many texts at once.

    A word's hash is a polynomial in its bytes, taken from running sums over the whole piece and
    divided by the power of its place, so it depends on the word alone.
    """

    def __init__(self, least: int = PIECE + PIECE // 4):
        self.power, self.inverse, self.least = np.zeros(0, np.uint64), np.zeros(0, np.uint64), least

    def grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, self.least)
            for name, base in (("power", _MULTIPLIER), ("inverse", pow(_MULTIPLIER, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of the words of a piece."""
        if not data:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        b = np.frombuffer(data.lower(), np.uint8)
        self.grow(len(b) + 1)
        white = np.ones(len(b) + 2, bool)
        white[1:-1] = _WHITE[b]
        edge = np.flatnonzero(white[1:] != white[:-1])
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_SPREAD[b] * self.power[: len(b)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)), starts

    def texts(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The word hashes of each text, in order; short texts are hashed together, long ones in pieces."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") < PIECE):
                size += len(texts[j] or b"") + 1
                j += 1
            if j == i + 1 and size > PIECE:
                parts, text, a = [], texts[i], 0
                while a < len(text):
                    cut = max(text.rfind(c, a, a + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if a + PIECE < len(text) else len(text)
                    cut = cut if cut > a else min([x for x in (text.find(c, a + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x > 0], default=len(text))
                    parts.append(self.of(text[a:cut])[0])
                    a = cut + 1
                yield np.concatenate(parts)
            else:
                part = [x or b"" for x in texts[i:j]]
                h, starts = self.of(b" ".join(part))
                ends = np.cumsum([len(x) + 1 for x in part])
                yield from np.split(h, np.searchsorted(starts, ends[:-1]))
            i = j


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def packed(values: np.ndarray) -> bytes:
    """An array as compressed byte planes; sorted unsigned arrays should be passed as differences."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return _PACK.compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(_UNPACK.decompress(data), np.uint8)
    if not len(planes):
        return np.zeros(0, dtype)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(dtype)


def packed_sorted(values: np.ndarray) -> bytes:
    """An ascending unsigned array."""
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def unpacked_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpacked(data, dtype), dtype=dtype)


#: Pieces into which the rows of a dealt join are cut, and the least rows of a piece.
PIECES, LEAST_PIECE = 10_000, 64


def dealt_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, by: list[str] | None = None) -> DataFrame:
    """Inner join of rows with facts, one row a key, where single keys may hold a large share of rows.

    facts.count says how many rows a key has, of total. Keys of more rows than a piece, at most
    PIECES of them, are dealt to several pieces and their facts repeated once a piece, so facts grow
    by 2 * PIECES rows at most and no task meets a whole hot key. A row's piece is a hash of its columns
    in `by` (default all), so a repeated task deals its rows as before.
    """
    piece = max(LEAST_PIECE, -(-total // PIECES))
    hot = facts.filter(F.col(count) > piece).select(*keys, F.ceil(F.col(count) / piece).cast("int").alias("_n"))
    n = F.coalesce("_n", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_piece", F.pmod(F.xxhash64(*(by or rows.columns)), n).cast("int")).drop("_n")
    n = F.greatest(F.lit(1), F.ceil(F.col(count) / piece).cast("int"))
    n = F.when(F.col(count) > piece, n).otherwise(F.lit(1))
    right = facts.withColumn("_piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.join(right, [*keys, "_piece"]).drop("_piece")


def connected(edges: DataFrame, work: str, rounds: int = 200) -> DataFrame:
    """Connected components of edges (a, b longs): rows (node, component), component being the smallest node.

    Each round points every node at the neighbour that comes first in a hashed order and
    contracts the edges; hashed order shortens chains by a constant share a round, so the rounds
    grow as the logarithm of the longest path. Joins are plain equi-joins whose hot keys the
    adaptive planner can split; minima are combined before the shuffle. Self links only name a
    node. An empty input gives an empty result. Work tables of a round are deleted when the next one is
    written. Should `rounds` not be enough, which no graph that fits a cluster needs, it raises RuntimeError.
    """
    spark = edges.sparkSession
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    now = saved(edges.select("a", "b").distinct(), f"{work}/edges0")
    labels = saved(now.select(F.col("a").alias("node")).union(now.select("b")).distinct().withColumn("label", F.col("node")), f"{work}/labels0")
    for k in range(1, rounds + 2):
        now = now.filter("a <> b")
        both = now.union(now.select("b", "a").toDF("a", "b"))
        first = saved(
            both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.when(F.xxhash64("a") < F.col("m.h"), F.col("a")).when((F.xxhash64("a") == F.col("m.h")) & (F.col("a") < F.col("m.v")), F.col("a")).otherwise(F.col("m.v")).alias("p")),
            f"{work}/first{k}",
        )
        if first.isEmpty():
            break
        if k > rounds:
            raise RuntimeError("components are not complete after all rounds")
        labels = saved(labels.join(first, labels.label == first.a, "left").select("node", F.coalesce("p", "label").alias("label")), f"{work}/labels{k}")
        second = first.toDF("b", "q")
        now = saved(now.join(first, "a").join(second, "b").select(F.col("p").alias("a"), F.col("q").alias("b")).filter("a <> b").distinct(), f"{work}/edges{k}")
        for old in (f"edges{k - 1}", f"labels{k - 1}", f"first{k}"):
            removed(spark, f"{work}/{old}")
        released(spark)
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
