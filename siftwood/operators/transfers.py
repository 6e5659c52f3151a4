"""Pieces, files, rates, queues and status of transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_spans(files: DataFrame, piece_length: int) -> DataFrame:
    """files(infohash, file_index, length) laid end to end: offset and the pieces [piece_begin, piece_end) of each. Empty files have none."""
    before = Window.partitionBy("infohash").orderBy("file_index").rowsBetween(Window.unboundedPreceding, -1)
    at = files.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    begin = F.floor(F.col("offset") / piece_length).cast("long")
    end = F.when(F.col("length") > 0, F.floor((F.col("offset") + F.col("length") - 1) / piece_length).cast("long") + 1).otherwise(begin)
    return at.withColumn("piece_begin", begin).withColumn("piece_end", end)


def wide_spans(files: DataFrame, piece_length: int) -> DataFrame:
    """What file_spans() gives, also for sets of any number of files: sums within ranges of files, then of ranges.

    A range of (infohash, file_index) is summed in its task; only a row for each range and set meets the others of its set. Rows of
    one place are laid in any order.
    """
    from siftwood.session import work_dir

    spark, work = files.sparkSession, work_dir(files.sparkSession)
    ranged = files.repartitionByRange("infohash", "file_index").withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(work)
    ranged = spark.read.parquet(work)
    order = Window.partitionBy("infohash", "_range").orderBy("file_index").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("infohash", "_range").agg(F.sum("length").alias("_total"))
    before = Window.partitionBy("infohash").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("infohash", "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    at = ranged.withColumn("_own", F.coalesce(F.sum("length").over(order), F.lit(0))).join(totals, ["infohash", "_range"]).withColumn("offset", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")
    begin = F.floor(F.col("offset") / piece_length).cast("long")
    end = F.when(F.col("length") > 0, F.floor((F.col("offset") + F.col("length") - 1) / piece_length).cast("long") + 1).otherwise(begin)
    return at.withColumn("piece_begin", begin).withColumn("piece_end", end)


def file_pieces(spans: DataFrame) -> DataFrame:
    """A row per (file, piece): the interval join by generating each file's own pieces."""
    return spans.filter("piece_end > piece_begin").withColumn("piece", F.explode(F.sequence(F.col("piece_begin"), F.col("piece_end") - 1)))


def completed_files(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """Files whose pieces have all arrived, with the time of the last; files without pieces are complete at once (null time).

    pieces: infohash, piece, ts; repeated arrivals count once, at the first.
    """
    first = pieces.groupBy("infohash", "piece").agg(F.min("ts").alias("ts"))
    got = file_pieces(spans).join(first, ["infohash", "piece"]).groupBy("infohash", "file_index").agg(F.count("*").alias("got"), F.max("ts").alias("completed_at"))
    out = spans.join(got, ["infohash", "file_index"], "left").filter(F.coalesce("got", F.lit(0)) == F.col("piece_end") - F.col("piece_begin"))
    return out.select("infohash", "file_index", "completed_at")


def rates(samples: DataFrame, least_ms: int = 100, order: list[str] | None = None) -> DataFrame:
    """Transfer rate by sample: bytes since the one before over the seconds between, not below 0.

    A sample less than least_ms after the one before holds the last known rate and isn't `measured`; the first has 0.
    order: what samples follow each other by, where times alone (ts) leave ties.
    """
    w = Window.partitionBy("infohash").orderBy(*(order or ["ts"]))
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag("ts").over(w).cast("timestamp"))
    moved = F.greatest(F.col("bytes") - F.lag("bytes").over(w), F.lit(0))
    known = samples.withColumn("_rate", F.when(ms >= least_ms, moved * 1000.0 / ms)).withColumn("measured", F.coalesce(ms >= least_ms, F.lit(True)))
    held = F.last("_rate", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("rate", F.coalesce(held, F.lit(0.0))).drop("_rate")


def progress(completed: Column, length: Column) -> Column:
    """Share that is done, at most 1; 0 for nothing to do."""
    return F.coalesce(F.least(completed / F.nullif(length, F.lit(0)), F.lit(1.0)), F.lit(0.0))


def status(has_info: Column, paused: Column, queued: Column, done: Column, seeding: Column, peers: Column) -> Column:
    """Status of a transfer."""
    return (
        F.when(paused, "paused")
        .when(queued, "queued")
        .when(~has_info, "fetching metadata")
        .when(done & seeding, "seeding")
        .when(done, "complete")
        .when(peers == 0, "stalled")
        .otherwise("downloading")
    )


def dashboard(rows: DataFrame) -> DataFrame:
    """By status: transfers, summed rates, signed and trusted ones."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("down_rate").alias("down_rate"), F.sum("up_rate").alias("up_rate"), F.count_if(F.col("signed_by").isNotNull()).alias("signed"), F.count_if("trusted").alias("trusted"))


def promoted(queue: DataFrame, active: int, capacity: int) -> DataFrame:
    """Queued transfers that may start: the first free places in queue order."""
    return queue.orderBy("queue_order", "infohash").limit(max(0, capacity - active))


def moved(queue: DataFrame, infohash: str, to_front: bool) -> DataFrame:
    """The queue with one entry moved before the first or behind the last."""
    edge = queue.agg(F.min("queue_order").alias("lo"), F.max("queue_order").alias("hi")).first()
    place = (edge.lo - 1 if to_front else edge.hi + 1) if edge.lo is not None else 0
    return queue.withColumn("queue_order", F.when(F.col("infohash") == infohash, F.lit(place)).otherwise(F.col("queue_order")))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Extraction counters by infohash: processed is the sum of extracted, skipped and failed."""
    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    return outcomes.groupBy("infohash").agg(n("extracted"), n("skipped"), n("failed")).withColumn("processed", F.col("extracted") + F.col("skipped") + F.col("failed"))


# Columns by which the list of transfers is sorted.
SORTABLE = ("name", "status", "progress", "size", "peers", "down_rate", "up_rate", "indexing", "signed_by")


def _sort_keys(column: str | None, desc: bool, key: str) -> list[Column]:
    if column is None:
        return [F.col(key).asc()]
    if column not in SORTABLE:
        raise ValueError(f"transfers can't be sorted by {column}")
    keys = {"indexing": [F.col("indexing"), F.col("name")], "signed_by": [F.col("signed_by") == "", F.col("signed_by")]}.get(column, [F.col(column)])
    return [*[k.desc() if desc else k.asc() for k in keys], F.col(key).asc()]


def sorted_by(rows: DataFrame, column: str | None, desc: bool = False, key: str = "infohash") -> DataFrame:
    """The list of transfers sorted by one of its columns, ties by key; None is the order of keys.

    Those that are being indexed come last and are ordered by name; signed ones come first.
    """
    return rows.orderBy(*_sort_keys(column, desc, key))


def numbered(rows: DataFrame, column: str | None, desc: bool = False, key: str = "infohash") -> DataFrame:
    """A short list with place, its rank in that order."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*_sort_keys(column, desc, key))).cast("long"))


def with_facts(rows: DataFrame, trusted: DataFrame, counters: DataFrame) -> DataFrame:
    """Transfers (infohash, signed_by) with trusted_publisher and indexed_files, from the trust list and the extraction counters."""
    names = trusted.select(F.lower("publisher").alias("_p")).distinct().withColumn("trusted_publisher", F.lit(True))
    done = counters.select("infohash", F.col("extracted").alias("indexed_files"))
    out = rows.join(names, F.lower("signed_by") == F.col("_p"), "left").drop("_p").join(done, "infohash", "left")
    return out.withColumns({"trusted_publisher": F.coalesce("trusted_publisher", F.lit(False)), "indexed_files": F.coalesce("indexed_files", F.lit(0)).cast("long")})
