"""Keyword posting lists of bounded size, their manifest, and the table that stands for a remote keyed store."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions import bencode
from siftwood.functions.text import keywords

#: Most encoded bytes of a posting list; minutes between two puts of a keyword.
LIST_BYTES, PUT_INTERVAL_MIN = 1000, 55


def hits_of(names: DataFrame, most: int | None = 8) -> DataFrame:
    """A posting per keyword of each name: names(publisher, infohash, name, seeders, size, files, seq)."""
    return names.withColumn("keyword", F.explode(keywords(F.col("name"), most)))


def digits(n: Column) -> Column:
    return F.length(n.cast("string")).cast("long")


def encoded_size(name: Column, seeders: Column, size: Column, files: Column) -> Column:
    """Bytes of one posting as a bencoded dictionary: f, ih (20 bytes), n, s, sz; zero fields are left out."""
    text = F.octet_length(F.coalesce(name, F.lit(""))).cast("long")
    number = lambda key, n: F.when(F.coalesce(n, F.lit(0)) != 0, F.lit(key + 2) + digits(n)).otherwise(F.lit(0).cast("long"))
    return F.lit(2 + 4 + 23).cast("long") + F.when(text > 0, F.lit(3) + digits(text) + 1 + text).otherwise(F.lit(0).cast("long")) + number(3, files) + number(3, seeders) + number(4, size)


#: Bytes of a list besides its postings: the outer dictionary with its hit list and time stamp.
LIST_FRAME = 2 + 6 + 2 + 4 + 12


def bounded_lists(hits: DataFrame, budget: int = LIST_BYTES) -> DataFrame:
    """The newest postings of each (publisher, keyword) that fit the budget.

    hits: publisher, keyword, infohash, name, seeders, size, files, seq. A later posting of an
    infohash replaces the earlier one in its place (its first seq); the oldest go until the list's
    encoded size fits. Equal seqs are ordered by infohash. Postings are shuffled once, by their list.
    """
    keys = ["publisher", "keyword"]
    one = hits.repartition(*keys).groupBy(*keys, "infohash").agg(F.min("seq").alias("place"), F.max_by(F.struct("name", "seeders", "size", "files"), F.struct("seq", "name")).alias("r")).select(*keys, "infohash", "place", "r.*")
    one = one.withColumn("bytes", encoded_size(F.col("name"), F.col("seeders"), F.col("size"), F.col("files")))
    newest = Window.partitionBy(*keys).orderBy(F.desc("place"), F.desc("infohash")).rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("used", F.sum("bytes").over(newest) + LIST_FRAME).filter(F.col("used") <= budget)


def as_lists(bounded: DataFrame) -> DataFrame:
    """One row per (publisher, keyword) with its postings, oldest first."""
    rows = F.array_sort(F.collect_list(F.struct("place", "infohash", "name", "seeders", "size", "files")))
    return bounded.groupBy("publisher", "keyword").agg(rows.alias("hits"), F.max("used").alias("bytes"))


def publisher_status(bounded: DataFrame) -> DataFrame:
    """Keywords and hits of each publisher."""
    per = bounded.groupBy("publisher", "keyword").agg(F.count("*").alias("hits"))
    return per.groupBy("publisher").agg(F.count("*").alias("keywords"), F.sum("hits").alias("hits"))


def due(manifest: DataFrame, now: Column, minutes: int = PUT_INTERVAL_MIN) -> DataFrame:
    """Keywords that may be put again: never put, or at least so many minutes ago."""
    return manifest.filter(F.col("last_published").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_published") >= minutes * 60))


def without_hit(hits: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without those of (keyword, infohash)."""
    return hits.join(gone.select("keyword", "infohash").distinct(), ["keyword", "infohash"], "left_anti")


def store_target(public_key: Column, salt: Column) -> Column:
    """Key of a mutable item: SHA-1 of key and salt."""
    return F.sha1(F.concat(public_key, salt.cast("binary")))


def put(store: DataFrame, items: DataFrame) -> DataFrame:
    """Append items(pk, salt, value) with the next sequence number of their key."""
    last = store.groupBy("pk", "salt").agg(F.max("seq").alias("seq"))
    new = items.join(last, ["pk", "salt"], "left").withColumn("seq", F.coalesce("seq", F.lit(0)) + 1)
    return store.unionByName(new.select(*store.columns))


def get(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The value with the highest sequence number of each key."""
    found = store.join(keys.select("pk", "salt").distinct(), ["pk", "salt"], "left_semi")
    return found.groupBy("pk", "salt").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def shards(hits: DataFrame, per_shard: int) -> DataFrame:
    """Postings of hot keywords dealt to numbered shards, newest first."""
    newest = Window.partitionBy("publisher", "keyword").orderBy(F.desc("seq"), "infohash")
    return hits.withColumn("shard", F.floor((F.row_number().over(newest) - 1) / per_shard).cast("int"))


#: Salt under which a publisher's index pointer lies; most bytes of a stored value.
INDEX_SALT, MOST_VALUE = hashlib.sha256(b"siftwood.index").hexdigest(), 1000


def pointers(rows: DataFrame, now: int) -> DataFrame:
    """Valid index pointers of rows(publisher, ih, commit, topics, next_pk binary, ts), with the bytes of their encoding.

    ih has 20 bytes; the others have 32, or are null or empty and left out. A time of 0 or null is
    now. Pointers above MOST_VALUE encoded bytes are refused as well.
    """
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    rows = rows.filter(size("ih") == 20)
    for c in ("commit", "topics", "next_pk"):
        rows = rows.filter(size(c).isin(0, 32))
    rows = rows.withColumn("ts", F.when(F.coalesce("ts", F.lit(0)) == 0, F.lit(now).cast("long")).otherwise(F.col("ts")))
    field = lambda key, c: F.when(size(c) > 0, F.lit(len(bencode.encode(key)) + 35)).otherwise(0)
    total = F.lit(2 + len(bencode.encode("ih")) + 23 + len(bencode.encode("ts")) + 2) + digits(F.col("ts")) + field("commit", "commit") + field("topics", "topics") + field("next_pk", "next_pk")
    return rows.withColumn("bytes", total.cast("long")).filter(F.col("bytes") <= MOST_VALUE)


def manifest_keywords(manifest: DataFrame) -> DataFrame:
    """The manifest's keywords, ascending."""
    return manifest.select("keyword").distinct().orderBy("keyword")
