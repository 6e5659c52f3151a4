"""The index of parents (torrents) and chunks: schemas, upserts, scans, deletes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 3
PARENTS = "infohash string, name string, file_paths array<string>, trackers array<string>, size_bytes bigint, file_count int, added_at timestamp, signed_by string"
CHUNKS = "infohash string, file_index int, file_path string, file_size bigint, mime string, text string, extractor string, indexed_at timestamp, chunk_index int"


def parent_key(infohash: Column) -> Column:
    return F.concat(F.lit("t:"), F.lower(infohash))


def chunk_key(infohash: Column, file_index: Column, chunk_index: Column) -> Column:
    return F.concat_ws(":", F.lit("c"), F.lower(infohash), file_index.cast("string"), chunk_index.cast("string"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one shuffle, with a row per key and task after the map-side aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert_parents(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Parents after put-or-replace by infohash. Rows without an infohash are refused; a missing count or date is derived."""
    new = new.filter("infohash is not null and infohash <> ''")
    new = new.withColumns({"infohash": F.lower("infohash"), "signed_by": F.lower("signed_by"), "file_count": F.coalesce(F.nullif("file_count", F.lit(0)), F.size(F.coalesce("file_paths", F.array()))), "added_at": F.coalesce("added_at", now)})
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, ["infohash"], ["_new", "added_at"]).drop("_new")


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after put-or-replace by (infohash, file, chunk). Rows without infohash or text are refused."""
    new = new.filter("infohash <> '' and text <> ''").withColumn("infohash", F.lower("infohash"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, ["infohash", "file_index", "chunk_index"], ["_new", "indexed_at"]).drop("_new")


def mixed(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Both kinds in one table, told apart by doc_type."""
    return parents.withColumn("doc_type", F.lit("torrent")).unionByName(chunks.withColumn("doc_type", F.lit("content")), allowMissingColumns=True)


def chunks_of(chunks: DataFrame, infohash: str) -> DataFrame:
    return chunks.filter(F.col("infohash") == infohash.lower())


def deleted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in keys; absent keys do nothing."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def statistics(index: DataFrame, index_bytes: int = 0) -> DataFrame:
    """One row: documents, parents, chunks, bytes of text, index bytes and their ratio (0 for no text)."""
    text = F.coalesce(F.sum(F.when(F.col("doc_type") == "content", F.octet_length("text"))), F.lit(0)).cast("long")
    out = index.agg(F.count("*").alias("doc_count"), F.count_if(F.col("doc_type") == "torrent").alias("torrent_count"), F.count_if(F.col("doc_type") == "content").alias("content_count"), text.alias("corpus_text_bytes"))
    return out.withColumn("index_bytes", F.lit(index_bytes).cast("long")).withColumn("ratio", F.when(F.col("corpus_text_bytes") > 0, F.col("index_bytes") / F.col("corpus_text_bytes")).otherwise(0.0))


def write_index(index: DataFrame, path: str) -> None:
    """Store the index, partitioned by kind, with its schema version beside it."""
    index.write.mode("overwrite").partitionBy("doc_type").parquet(f"{path}/rows")
    index.sparkSession.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/version")


def open_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored index, or an empty one if there is none or its schema version is another."""
    try:
        version = spark.read.schema("version int").json(f"{path}/version").first()
        if version and version.version == SCHEMA_VERSION:
            return spark.read.parquet(f"{path}/rows")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame([], schema)


def first_in(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in an order: capacity by first insert or by last touch."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in a total order: a top-k per task, then one merge."""
    return rows.orderBy(*order).limit(most)


def page_of(rows: DataFrame, order: list[Column], start: int = 0, size: int = 1000) -> DataFrame:
    """Rows start to start + size of a total order."""
    return rows.orderBy(*order).offset(start).limit(size)
