"""Streams: file ingest, piece completion, rate limits, expiring records, publisher rounds, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwood.operators.peers import BURST, REFILL
from siftwood.sources.extractors import extracted


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Chunks of files as they appear in a folder; the bound on files of a batch is the back-pressure."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return extracted(rows)


def upserting(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each chunk in a batch before it writes."""

    def run(batch: DataFrame, number: int) -> None:
        write(batch.filter("outcome = 'extracted'").dropDuplicates(["path", "chunk_index"]), number)

    return run


def completed_stream(arrivals: DataFrame) -> DataFrame:
    """Files whose pieces have all arrived, once each.

    arrivals: infohash, file_index, piece, needed (pieces of the file). State holds the distinct pieces
    so far and is dropped for a mark when the file is complete.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else ([], False)
        seen = set(seen)
        for f in frames:
            if done:
                continue
            seen |= set(map(int, f.piece))
            if len(seen) >= int(f.needed.iloc[0]):
                done, seen = True, set()
                yield pd.DataFrame([(*key,)], columns=["infohash", "file_index"])
        state.update((sorted(seen), done))

    return arrivals.groupBy("infohash", "file_index").applyInPandasWithState(run, "infohash string, file_index int", "seen array<long>, done boolean", "append", GroupStateTimeout.NoTimeout)


def limited_stream(requests: DataFrame, refill: float = REFILL, burst: float = BURST) -> DataFrame:
    """requests(peer, ts) with allowed: the token bucket of each peer as state."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        out = []
        for ts in sorted(ts for f in frames for ts in f.ts):  # a peer's requests of one batch
            at = ts.timestamp()
            tokens = min(burst, tokens + (max(0.0, at - last) * refill if last is not None else 0.0))
            ok = tokens >= 1 - 1e-9
            tokens, last = tokens - ok, at
            out.append((key[0], ts, bool(ok)))
        yield pd.DataFrame(out, columns=["peer", "ts", "allowed"])
        state.update((float(tokens), last))

    return requests.select("peer", "ts").groupBy("peer").applyInPandasWithState(run, "peer string, ts timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def fresh_records(records: DataFrame, ttl: str = "30 days") -> DataFrame:
    """Records of each id once while it is remembered: event time `ts`, forgotten after the ttl."""
    return records.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events by type and window of event time (an extension; the same plan serves batches)."""
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def answered_stream(queries: DataFrame, answers: DataFrame, seconds: int = 3) -> DataFrame:
    """Answers of known queries (txid) that come within the deadline; unknown transactions are dropped."""
    q = queries.withWatermark("asked_at", "1 minute")
    a = answers.withWatermark("answered_at", "1 minute").withColumnRenamed("txid", "_txid")
    near = (F.col("txid") == F.col("_txid")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {seconds} seconds"))
    return q.join(a, near).drop("_txid")


def gathered_stream(asked: DataFrame, answers: DataFrame, seconds: int = 3, late: str = "1 minute") -> DataFrame:
    """asked(txid, peer, asked_at) with the answers(txid, peer, answered_at, rejected) that come within the deadline, or one timeout.

    outcome: answered, rejected or timeout; a timeout is told once the watermark, `late` behind the newest rows of
    both streams, has passed the deadline. Answers to nobody and late ones are dropped, and state with them.
    """
    q = asked.withWatermark("asked_at", late)
    a = answers.select(F.col("txid").alias("_txid"), F.col("peer").alias("_peer"), "answered_at", "rejected").withWatermark("answered_at", late)
    near = (F.col("txid") == F.col("_txid")) & (F.col("peer") == F.col("_peer")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {seconds} seconds"))
    outcome = F.when(F.col("_txid").isNull(), "timeout").when(F.col("rejected"), "rejected").otherwise("answered")
    return q.join(a, near, "left_outer").withColumn("outcome", outcome).drop("_txid", "_peer")
