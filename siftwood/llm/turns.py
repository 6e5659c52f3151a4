"""Conversations put together from turns that arrive out of order, in batches, more than once or too late."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import saved, shared_dir, shuffle_partitions

#: Batches of a run, and how many batches in a row without an arrival close a conversation.
BATCHES, IDLE = 10, 2
EVENTS = "conv_id long, event string, turn long, batch int, role string, payload string, unreleased array<long>, n_missing long, n_breaks long"
#: For the state of the stream alone: stores of runs that have ended go soon, and hold no space ahead.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _millis(batch: int) -> int:
    """Event time of a batch; the watermark starts at 0, so the first batch stands behind it."""
    return (batch + 1) * 1000


class Reassembly(StatefulProcessor):
    """The state of one conversation.

    `head` holds its first turn, the next turn to release with the role before it, the largest kept turn, the
    last batch with an arrival and two counts; `waiting` the kept turns behind a gap, each an entry of its own;
    `closed` is the tombstone. A timer stands at the batch in which the conversation closes if nothing
    more arrives: each arrival deletes it and registers a later one. Released turns leave the state.
    """

    def __init__(self, idle: int, end: int):
        self.idle, self.end = idle, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "first long, next long, before string, top long, n_kept long, n_breaks long, last int")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, payload string")
        self.closed = handle.getValueState("closed", "batch int")

    def _event(self, key, event: str, turn: int, batch: int, role=None, payload=None, unreleased=None, missing=None, breaks=None) -> Row:
        return Row(conv_id=key[0], event=event, turn=turn, batch=batch, role=role, payload=payload, unreleased=unreleased, n_missing=missing, n_breaks=breaks)

    @staticmethod
    def _waits(head: tuple | None) -> bool:
        """Whether a kept turn waits behind a gap."""
        return head is not None and head[4] > head[1] - head[0]

    def _close(self, key, head: tuple, batch: int) -> Row:
        first, _, _, top, n_kept, n_breaks, _ = head
        left = sorted(turn for (turn,) in self.waiting.keys()) if self._waits(head) else []
        self.head.clear()
        if left:
            self.waiting.clear()
        self.closed.update((batch,))
        return self._event(key, "close", -1, batch, unreleased=left, missing=top - first + 1 - n_kept if n_kept else 0, breaks=n_breaks)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[1]:  # the batch's own row, which only moves the watermark
            return
        head = self.head.get()
        gone, timer, some = head is None and self.closed.exists(), None if head is None else head[6] + self.idle, self._waits(head)
        for row in rows:
            if head is not None and row.batch > head[6] + self.idle:  # its timer is due, and fires behind this batch's rows
                if timer is not None:
                    self.handle.deleteTimer(_millis(timer))
                yield self._close(key, head, head[6] + self.idle)
                head, gone, timer, some = None, True, None, False
            if gone:
                yield self._event(key, "reject", row.turn, row.batch, row.role, row.payload)
                continue
            first, upto, before, top, n_kept, n_breaks, _ = head or (row.first, row.first, None, None, 0, 0, row.batch)
            held = row.turn >= upto and some and row.turn <= top and self.waiting.containsKey((row.turn,))
            if row.turn >= upto and not held:
                if row.turn == upto:
                    n_breaks += n_kept > 0 and upto > first and before == row.role
                else:
                    left = self.waiting.getValue((row.turn - 1,)) if some and row.turn - 1 <= top else None
                    n_breaks += left is not None and left[0] == row.role
                n_kept, fresh, top = n_kept + 1, row.turn > (top if top is not None else row.turn - 1), row.turn if top is None else max(top, row.turn)
                right = None if fresh or not some else self.waiting.getValue((row.turn + 1,))
                n_breaks += right is not None and right[0] == row.role
                if row.turn > upto:
                    self.waiting.updateValue((row.turn,), (row.role, row.payload))
                    some = True
                else:
                    role, payload = row.role, row.payload
                    while True:
                        yield self._event(key, "release", upto, row.batch, role, payload)
                        before, upto = role, upto + 1
                        found = right if upto == row.turn + 1 else self.waiting.getValue((upto,)) if some and upto <= top else None
                        if found is None:
                            break
                        role, payload = found
                        self.waiting.removeKey((upto,))
            head = (first, upto, before, top, n_kept, int(n_breaks), max(row.batch, head[6]) if head else row.batch)
        if head is not None:
            if timer != head[6] + self.idle:
                if timer is not None:
                    self.handle.deleteTimer(_millis(timer))
                self.handle.registerTimer(_millis(head[6] + self.idle))
            self.head.update(head)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self.head.get()
        if head is not None:
            yield self._close(key, head, min(head[6] + self.idle, self.end))

    def close(self) -> None:
        pass


def dealt_arrivals(turns: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The arrivals of turns: conv_id, turn, role, payload, batch, first.

    turns: conv_id, turn, role, text; other columns are ignored. Null turns are dropped, null roles and texts are
    empty, a null conv_id is a conversation of its own. A turn arrives in the batch that a hash of its
    name says, two in seven once more, as a user's, half a run later. Of the rows of one turn in one batch only
    that of the smallest payload (role|text, by bytes) arrives, so repeated rows arrive once. `first` is the
    conversation's smallest turn. An empty table has no arrivals.
    """
    turns = turns.filter("turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    once = F.struct((F.col("h") % batches).cast("int").alias("batch"), F.col("role"))
    again = F.struct(((F.col("h") + batches // 2) % batches).cast("int").alias("batch"), F.lit("user").alias("role"))
    rows = turns.withColumn("h", h).withColumn("a", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once))))
    rows = rows.select("conv_id", "turn", F.col("a.batch").alias("batch"), F.concat("a.role", F.lit("|"), "text").alias("payload"), F.col("a.role").alias("role"))
    least = rows.groupBy("conv_id", "turn", "batch").agg(F.min(F.struct("payload", "role")).alias("p")).select("conv_id", "turn", "p.role", "p.payload", "batch")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "_conv")
    return least.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def _moved(spark, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved")


def reassemble(arrivals: DataFrame, batches: int = BATCHES, idle: int = IDLE) -> DataFrame:
    """Events of conversations whose turns come in batches 0 to batches - 1: release, reject, close.

    arrivals: conv_id, turn, role, payload, batch, first; one row a turn and batch. They are written below
    spark.checkpoint.dir, a folder a batch, and the folders are moved one after another to where a stateful
    query looks for them, which is started anew for each on one checkpoint, so it may also be ended and
    started between any two. Every folder holds one more row that moves the watermark, which
    counts batches, even if nothing arrives; the last holds another that moves it past the end, and an empty batch behind it lets all timers
    fire. Before, a timer fires behind the rows of the batch after its own; rows of that batch that come first close the conversation themselves.

    release (conv_id, turn, batch, role, payload): a turn of the gapless run from `first`, once; the first arrival
    of a turn counts. close: after `idle` batches in a row without arrivals, in the last of them, or at the
    end, as batch `batches`; with the kept turns that were never released, the number of those missing up to the largest
    kept one, and of kept turns that repeat the role of the turn before. reject: all arrivals after closing.
    State of a conversation is kept in its task's store, an entry a waiting turn: memory doesn't grow with its length.
    An empty table gives no events.
    """
    spark, work = arrivals.sparkSession, shared_dir(arrivals.sparkSession)
    fields = ["conv_id", "turn", "role", "payload", "batch", "first"]
    kind = arrivals.schema["conv_id"].dataType
    rows = arrivals.select(*fields, F.lit(False).alias("tick"))
    ticks = spark.range(batches + 1).select(F.lit(None).cast(kind).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("payload"), F.col("id").cast("int").alias("batch"), F.lit(0).cast("long").alias("first"), F.lit(True).alias("tick"))
    at = F.when(F.col("batch") < batches, F.col("batch")).otherwise(batches + idle)
    pieces = max(1, shuffle_partitions(spark) // batches)
    rows = rows.union(ticks).withColumn("at", F.timestamp_seconds(at + 1)).withColumn("folder", F.least("batch", F.lit(batches - 1)))
    rows = rows.repartition("folder", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(pieces)))
    rows.write.partitionBy("folder").parquet(f"{work}/batches")
    schema = rows.drop("folder").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/arrived")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    held = {k: spark.conf.get(k, None) for k in [*_SETTINGS, _EMPTY_BATCHES]}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        for b in range(batches):
            spark.conf.set(_EMPTY_BATCHES, str(b == batches - 1).lower())
            _moved(spark, f"{work}/batches/folder={b}", f"{work}/arrived/{b:06d}")
            found = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{work}/arrived").withWatermark("at", "0 seconds")
            events = found.groupBy("conv_id", "tick").transformWithState(Reassembly(idle, batches), EVENTS, "Append", "EventTime")
            query = events.writeStream.format("parquet").option("path", f"{work}/events").option("checkpointLocation", f"{work}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(EVENTS).parquet(f"{work}/events")
