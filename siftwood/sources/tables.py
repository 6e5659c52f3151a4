"""Record and state files: JSON lines and JSON documents, checked as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records {ih, kw, t} by line; empty lines are skipped, a bad one fails the query and is named."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("r", F.from_json("value", "ih string, kw string, t bigint"))
    good = F.coalesce((F.length("r.ih") == 40) & F.lower("r.ih").rlike("^[0-9a-f]{40}$") & (F.col("r.kw") != ""), F.lit(False))
    checked = F.when(good, F.unhex("r.ih")).otherwise(F.raise_error(F.concat(F.lit("bad record line: "), F.substring("value", 1, 200))).cast("binary"))
    return lines.select(checked.alias("ih"), F.col("r.kw").alias("kw"), F.coalesce("r.t", F.lit(0)).alias("t"))


def read_state(spark: SparkSession, path: str, schema: str, needed: list[str]) -> DataFrame:
    """A JSON state table; rows without their needed fields are dropped."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    for c in needed:
        rows = rows.filter(F.col(c).isNotNull())
    return rows


def write_state(rows: DataFrame, path: str) -> None:
    """Replace a state table; Spark's committer makes the files appear together."""
    rows.write.mode("overwrite").json(path)


def file_pieces(files: DataFrame, piece_length: int) -> DataFrame:
    """files(path, content): SHA-1 of each piece of each file."""
    from siftwood.operators.snapshot import piece_hashes

    return piece_hashes(files, piece_length)


def metainfo_pieces(files: DataFrame, piece_length: int) -> DataFrame:
    """files(path, content) laid end to end in order of path: piece, sha1. Pieces go over the bounds of files; one is built of the parts that lie in it."""
    from siftwood.operators.transfers import file_pieces, wide_spans

    rows = files.select(F.lit("").alias("infohash"), F.col("path").alias("file_index"), F.octet_length("content").cast("long").alias("length"))
    spans = wide_spans(rows, piece_length).select(F.col("file_index").alias("path"), "offset", "piece_begin", "piece_end")
    begin = F.greatest(F.lit(0), F.col("piece") * piece_length - F.col("offset"))
    end = (F.col("piece") + 1) * piece_length - F.col("offset")
    # a file's bytes travel once, to its span; positions within them fit an int
    cut = file_pieces(spans.join(files.select("path", "content"), "path")).select("piece", "offset", F.substring(F.col("content"), (begin + 1).cast("int"), F.least(end - begin, F.lit(2**31 - 1)).cast("int")).alias("part"))
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: F.hex(x.part)), ""))
    return cut.groupBy("piece").agg(F.sha1(whole).alias("sha1"))


def metainfo(files: DataFrame, name: str, piece_length: int) -> bytes:
    """The bencoded info dictionary of files(path, content): a digest of 20 bytes a piece and a row a file reach the driver."""
    from siftwood.functions import bencode

    rows = files.select("path", F.octet_length("content").alias("n")).orderBy("path").collect()
    pieces = b"".join(bytes.fromhex(r.sha1) for r in metainfo_pieces(files, piece_length).orderBy("piece").collect())
    return bencode.encode({"files": [{"length": r.n, "path": r.path.strip("/").split("/")} for r in rows], "name": name, "piece length": piece_length, "pieces": pieces})


def piece_length(total: int, least: int = 16 << 10, most: int = 4 << 20, pieces: int = 1500) -> int:
    """A power of two that cuts total bytes into about so many pieces."""
    size = least
    while size < most and total / size > pieces:
        size *= 2
    return size
