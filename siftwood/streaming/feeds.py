"""Streams fed in slices of event time: one checkpoint, a start for each slice, as after a stop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.session import work_dir

#: Settings of streams whose operators keep timers and several states; stores of ended runs go soon and hold no space ahead.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block."""
    held = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def time_slices(rows: DataFrame, at: str, n: int) -> DataFrame:
    """rows with `slice`, 0 to n - 1: equal spans of the time in `at`; rows without a time are in the first."""
    span = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if span.a is None:
        return rows.withColumn("slice", F.lit(0))
    first, width = F.lit(span.a), max(1e-6, (span.b - span.a).total_seconds() / n)
    since = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return rows.withColumn("slice", F.coalesce(F.least(F.lit(n - 1), F.floor(since / F.lit(1e6 * width)).cast("int")), F.lit(0)))


def fed(rows: DataFrame, slices: int, plan: Callable[[DataFrame], DataFrame], slice_of: Column | str = "slice", conf: dict[str, str] | None = None) -> DataFrame:
    """What the stream plan(rows) gives in append mode, fed slice by slice.

    rows are written below the shared folder, a folder a slice; each is moved to where the stream looks for files, and the query
    is started anew on its checkpoint until no more is to do. Its output is a file sink's, which counts a batch
    once even if it is repeated.
    """
    spark, work = rows.sparkSession, work_dir(rows.sparkSession)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(work).getFileSystem(spark._jsc.hadoopConfiguration())
    schema = rows.drop("slice").schema
    rows.withColumn("_slice", F.col(slice_of) if isinstance(slice_of, str) else slice_of).drop("slice").repartition("_slice", F.pmod(F.xxhash64(*schema.names), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // slices)))).write.partitionBy("_slice").parquet(f"{work}/slices")
    files.mkdirs(path(f"{work}/arrived"))
    files.mkdirs(path(f"{work}/out"))  # nothing may ever be written
    out = None
    with settings(spark, KEYED_STATE | (conf or {})):
        for k in range(slices):
            source = path(f"{work}/slices/_slice={k}")
            if files.exists(source) and not files.rename(source, path(f"{work}/arrived/{k:06d}")):
                raise OSError(f"slice {k} could not be moved")
            out = plan(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{work}/arrived"))
            query = out.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{work}/out")
