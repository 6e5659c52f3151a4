"""Nested index snapshots: build, encode, decode, publish, subscribe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, FORMAT = 1, "siftwood-content-index"
CHUNK = "struct<text:string,offset:bigint>"
FILE = f"struct<index:int,path:string,size:bigint,mime:string,extractor:string,chunks:array<{CHUNK}>>"
TORRENT = f"struct<infohash:string,name:string,size:bigint,added_at:bigint,files:array<{FILE}>>"
SCHEMA = "version int, format string, publisher string, generated_at bigint, infohash string, name string, size bigint, added_at bigint, files array<" + FILE + ">"


def nested(torrents: DataFrame, content: DataFrame, max_files: int | None = None, max_chunks: int | None = None) -> DataFrame:
    """A row per torrent with its files and their chunks.

    torrents: infohash, name, size, added_at, file_paths; content: infohash, file_index, file_size,
    mime, extractor, chunk_index, text, offset. The torrent's list of files leads: files without
    chunks stay, chunks of other indexes are dropped. Caps keep the first files and chunks.
    """
    chunk = F.array_sort(F.collect_list(F.struct("chunk_index", "text", "offset")))
    chunk = F.transform(chunk if max_chunks is None else F.slice(chunk, 1, max_chunks), lambda c: F.struct(c.text.alias("text"), c.offset.alias("offset")))
    per_file = content.groupBy("infohash", "file_index").agg(F.max("file_size").alias("file_size"), F.max("mime").alias("mime"), F.max("extractor").alias("extractor"), chunk.alias("chunks"))
    paths = F.coalesce("file_paths", F.array()) if max_files is None else F.slice(F.coalesce("file_paths", F.array()), 1, max_files)
    files = torrents.select("infohash", F.posexplode(paths).alias("file_index", "path")).join(per_file, ["infohash", "file_index"], "left")
    entry = F.struct(F.col("file_index").alias("index"), "path", F.coalesce("file_size", F.lit(0)).cast("long").alias("size"), F.coalesce("mime", F.lit("")).alias("mime"), F.coalesce("extractor", F.lit("")).alias("extractor"), F.coalesce("chunks", F.array().cast(f"array<{CHUNK}>")).alias("chunks"))
    lists = files.groupBy("infohash").agg(F.array_sort(F.collect_list(entry)).alias("files"))
    out = torrents.select("infohash", "name", "size", "added_at").join(lists, "infohash", "left")
    return out.withColumn("files", F.coalesce("files", F.array().cast(f"array<{FILE}>")))


def write_snapshot(rows: DataFrame, path: str, publisher: str, generated_at: int) -> None:
    """Gzip JSON lines, a torrent each with the envelope's fields; many files at scale, committed by Spark's writer."""
    envelope = [F.lit(VERSION).alias("version"), F.lit(FORMAT).alias("format"), F.lit(publisher).alias("publisher"), F.lit(generated_at).alias("generated_at")]
    rows.select(F.to_json(F.struct(*envelope, *rows.columns)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot's torrents; rows of another format or version fail the query."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    good = (F.col("version") == VERSION) & (F.col("format") == FORMAT)
    rows = rows.withColumn("version", F.when(good, F.col("version")).otherwise(F.raise_error(F.lit("snapshot of another format or version")).cast("int")))
    return rows.filter("version is not null").withColumn("files", F.coalesce("files", F.array().cast(f"array<{FILE}>")))


def to_document(rows: DataFrame, publisher: str, generated_at: int) -> DataFrame:
    """One row: a whole small snapshot as one JSON document, torrents by infohash."""
    torrents = F.array_sort(F.collect_list(F.struct("infohash", "name", "size", "added_at", "files")))
    return rows.agg(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(FORMAT).alias("format"), F.lit(publisher).alias("publisher"), F.lit(generated_at).alias("generated_at"), torrents.alias("torrents"))).alias("document"))


def flattened(rows: DataFrame) -> DataFrame:
    """A row per chunk: infohash, file_index, path, chunk_index, text, offset."""
    files = rows.select("infohash", F.explode("files").alias("f"))
    return files.select("infohash", F.col("f.index").alias("file_index"), F.col("f.path").alias("path"), F.posexplode("f.chunks").alias("chunk_index", "c")).select("infohash", "file_index", "path", "chunk_index", F.col("c.text").alias("text"), F.col("c.offset").alias("offset"))


def piece_hashes(content: DataFrame, piece_length: int = 256 << 10) -> DataFrame:
    """content(path, content binary): path, piece, sha1 of each piece."""
    pieces = content.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("content") - 1) / piece_length)).cast("int"))))
    return pieces.select("path", "piece", F.sha1(F.substring(F.col("content"), F.col("piece") * piece_length + 1, F.lit(piece_length))).alias("sha1"))


def newer(followed: DataFrame, ingested: DataFrame) -> DataFrame:
    """Followed snapshots (publisher, generated_at, path) that are newer than what was ingested."""
    last = ingested.groupBy("publisher").agg(F.max("generated_at").alias("_last"))
    return followed.join(last, "publisher", "left").filter(F.col("_last").isNull() | (F.col("generated_at") > F.col("_last"))).drop("_last")


def age_days(now: Column, ts: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(ts)) / F.lit(86400.0)
