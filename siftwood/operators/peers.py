"""Peers: capabilities, rate limits, bans, the peer book, targets of a query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Capability bits and the points of misbehaviour.
BITS = {"share_local": 1, "share_swarm": 2, "file_hits": 4, "content_hits": 8, "layer_d_publisher": 16, "companion_publisher": 32, "companion_subscriber": 64, "snippet_highlight": 128, "regtest": 256, "set_reconciliation": 512}
POINTS = {"bad_bencode": 20, "rate_limited": 5, "malformed_result": 10, "query_too_broad": 5, "stale_txid": 10, "unexpected_message": 10, "bad_record_sig": 20, "insufficient_pow": 10}
BAN_POINTS, BAN_HOURS = 100, 24
#: Token bucket of a peer: tokens a second and most tokens.
REFILL, BURST = 5.0, 10.0
#: Places of the peer book for new and tried peers; feelers of a query.
NEW_PLACES, TRIED_PLACES, FEELERS = 1024, 256, 2


def has(services: Column, name: str) -> Column:
    """Whether a capability bit is set; unknown bits don't matter."""
    return services.bitwiseAND(BITS[name]) == BITS[name]


def with_bit(services: Column, name: str, on: bool = True) -> Column:
    return services.bitwiseOR(BITS[name]) if on else services.bitwiseAND(F.lit(~BITS[name]))


def capabilities(services: Column) -> Column:
    """Names of the set bits, in bit order."""
    return F.filter(F.array(*[F.when(has(services, n), F.lit(n)) for n in BITS]), lambda x: x.isNotNull())


def charged(messages: DataFrame) -> DataFrame:
    """messages(peer, ts, offence) with the points of each offence; other messages cost nothing."""
    table = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    return messages.withColumn("points", F.coalesce(F.try_element_at(table, F.col("offence")), F.lit(0)))


def _by_peer(rows: DataFrame, fold, schema: str) -> DataFrame:
    """An ordered fold over the rows of each peer, in batches of a sorted partition; state is one small record."""
    ordered = rows.repartition(F.col("peer")).sortWithinPartitions("peer", "ts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        peer, state = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.peer != peer:
                    peer, state = row.peer, None
                state, made = fold(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return ordered.mapInPandas(run, schema)


def rate_limited(requests: DataFrame, refill: float = REFILL, burst: float = BURST) -> DataFrame:
    """requests(peer, ts) with allowed: a token bucket per peer that starts full; limits up to 0 let all pass.

    Peers' rows are folded in time order from sorted partitions, never gathered, so a peer with any
    number of rows needs one number of state.
    """
    if refill <= 0 or burst <= 0:
        return requests.select("peer", "ts", F.lit(True).alias("allowed"))

    def fold(state, row):
        tokens, last = (burst, row.ts) if state is None else state
        tokens = min(burst, tokens + max(0.0, (row.ts - last).total_seconds()) * refill)
        ok = tokens >= 1 - 1e-9
        return (tokens - ok, row.ts), (row.peer, row.ts, ok)

    return _by_peer(requests.select("peer", "ts"), fold, "peer string, ts timestamp, allowed boolean")


def bans(charges: DataFrame, threshold: int = BAN_POINTS, hours: int = BAN_HOURS) -> DataFrame:
    """charges(peer, ts, points) with score and banned after each: points add up, a ban starts at the threshold and its end resets the score."""
    span = pd.Timedelta(hours=hours)

    def fold(state, row):
        score, until = (0, None) if state is None else state
        if until is not None and row.ts >= until:
            score, until = 0, None
        score += int(row.points)
        if until is None and score >= threshold:
            until = row.ts + span
        return (score, until), (row.peer, row.ts, score, until is not None)

    return _by_peer(charges.select("peer", "ts", "points"), fold, "peer string, ts timestamp, score long, banned boolean")


def peer_book(contacts: DataFrame, new_places: int = NEW_PLACES, tried_places: int = TRIED_PLACES) -> DataFrame:
    """The peer book after contacts(peer, ts, ok): tried once any succeeded, failures since the last success.

    Beyond its places the oldest new and the longest unused tried peers go: a top-k of each kind.
    """
    ok = contacts.groupBy("peer").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_used"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"))
    failed = contacts.filter(~F.col("ok")).select("peer", "ts").join(ok.select("peer", "last_ok"), "peer").filter(F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok")))
    book = ok.join(failed.groupBy("peer").agg(F.count("*").alias("failures")), "peer", "left")
    book = book.select("peer", "first_seen", "last_used", F.col("last_ok").isNotNull().alias("tried"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))
    tried = book.filter("tried").orderBy(F.desc("last_used"), "peer").limit(tried_places)
    return tried.unionByName(book.filter("not tried").orderBy(F.desc("first_seen"), "peer").limit(new_places))


def targets(book: DataFrame, feelers: int = FEELERS) -> DataFrame:
    """Peers that a query asks: all tried ones and some new ones; everyone while none is tried."""
    if book.filter("tried").isEmpty():
        return book
    return book.filter("tried").unionByName(book.filter("not tried").orderBy("first_seen", "peer").limit(feelers))


def peer_counts(peers: DataFrame) -> DataFrame:
    """One row: known peers and those that answer searches."""
    return peers.agg(F.count("*").alias("known"), F.count_if(has(F.col("services"), "share_local")).alias("capable"))


def state_rollup(peers: DataFrame, indexers: DataFrame, anchors: DataFrame, admitted: DataFrame, observed: DataFrame, cache: DataFrame, most: int) -> DataFrame:
    """One row of the status page: known and capable peers, indexers, anchors, admitted and pending publishers, cached records up to `most`."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    waiting = observed.select("publisher").distinct().join(admitted.select("publisher"), "publisher", "left_anti")
    out = peer_counts(peers).toDF("known_peers", "capable_peers")
    for one in (count(indexers.select("publisher").distinct(), "indexers"), count(anchors.select("publisher").distinct(), "anchors"), count(admitted, "admitted"), count(waiting, "pending"), cache.agg(F.least(F.count("*"), F.lit(most)).cast("long").alias("cached_records"))):
        out = out.join(one)  # tables of one row
    return out
