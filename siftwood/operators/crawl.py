"""Crawling: infohash samples, signed metainfo, outcome classes, gossip, known-good confirmation, followed snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwood.functions import bencode, ed25519
from siftwood.operators import documents, snapshot
from siftwood.session import spread

#: Keys of a metainfo's publisher and signature, and what precedes the info hash in the signed message.
KEY_FIELD, SIG_FIELD, DOMAIN = b"publisher.pubkey", b"publisher.sig", b"siftwood-metainfo-v1:"
#: Outcome classes of a crawled sample.
CLASSES = ("forwarded", "bad_signature", "unsigned", "malformed", "fetch_error")
#: Endorsements that count of one announcement.
MOST_ENDORSED = 10


def sampled(responses: DataFrame) -> DataFrame:
    """Samples of responses(node, samples binary, interval, num): a row per 20-byte id of each response; a torn last id is dropped."""
    n = F.floor(F.octet_length("samples") / 20).cast("int")
    rows = responses.filter(n > 0).select("node", "interval", "num", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("samples"), i * 20 + 1, F.lit(20)))).alias("place", "ih"))
    return rows.select("node", "interval", "num", "place", F.lower(F.hex("ih")).alias("infohash"))


def signed_metainfo(info: bytes, seed: bytes) -> bytes:
    """A metainfo with this encoded info dictionary, signed."""
    return signed_metainfos([info], seed)[0]


def signed_metainfos(infos: list[bytes], seed: bytes) -> list[bytes]:
    """Metainfos with these encoded info dictionaries, signed."""
    key, sigs = bencode.encode(ed25519.public_key(seed)), ed25519.sign_all(seed, [DOMAIN + hashlib.sha1(i).digest() for i in infos])
    parts = [{b"info": i, KEY_FIELD: key, SIG_FIELD: bencode.encode(s)} for i, s in zip(infos, sigs, strict=True)]
    return [b"d" + b"".join(bencode.encode(k) + v for k, v in sorted(p.items())) + b"e" for p in parts]


def _opened(raw: bytes | None) -> tuple[str | None, tuple[bytes, bytes, bytes] | None]:
    """(class, None) of a fetched metainfo, or (None, (key, message, signature)) where its signature decides."""
    if raw is None:
        return "fetch_error", None
    try:
        d = bencode.decode(raw)
        info = bencode.encode(d[b"info"])
        if not d[b"info"]:
            return "malformed", None
        key, sig = d.get(KEY_FIELD), d.get(SIG_FIELD)
        if key is None or sig is None:
            return "unsigned", None
        if len(key) != 32 or len(sig) != 64:
            return "malformed", None
    except (ValueError, KeyError, TypeError, IndexError, AttributeError):
        return "malformed", None
    return None, (key, DOMAIN + hashlib.sha1(info).digest(), sig)


def metainfo_classes(raws: list[bytes | None]) -> list[tuple[str, bytes | None]]:
    """(class, publisher) of fetched metainfos; the publisher of a bad signature is the claimed one."""
    found = [_opened(r) for r in raws]
    valid = iter(ed25519.verify_all([s for _, s in found if s]))
    return [(kind, None) if s is None else ("forwarded" if next(valid) else "bad_signature", s[0]) for kind, s in found]


def metainfo_class(raw: bytes | None) -> tuple[str, bytes | None]:
    return metainfo_classes([raw])[0]


def crawled(samples: DataFrame, fetched: DataFrame) -> DataFrame:
    """samples(infohash) with class and publisher (hex): fetched(infohash, raw binary) holds what could be fetched, once an infohash.

    What was fetched is classed before it meets the samples, so that an infohash sampled often is verified once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = metainfo_classes([bytes(x) if x is not None else None for x in f["raw"]])
            yield pd.DataFrame({"infohash": f["infohash"], "class": [k for k, _ in found], "publisher": [p.hex() if p else None for _, p in found]})

    classed = spread(fetched.select("infohash", "raw")).mapInPandas(run, StructType([fetched.schema["infohash"]]).add("class", "string").add("publisher", "string"))
    rows = samples.join(classed, "infohash", "left")
    return rows.select(*samples.columns, F.coalesce("class", F.lit("fetch_error")).alias("class"), "publisher")


def outcomes(rows: DataFrame) -> DataFrame:
    """One row: how many samples fell into each class."""
    return rows.agg(*[F.count_if(F.col("class") == c).alias(c) for c in CLASSES])


def observed(rows: DataFrame) -> DataFrame:
    """Publishers that a crawl forwards, with the number of samples of valid and of bad signatures."""
    return rows.filter("publisher is not null").groupBy("publisher").agg(F.count_if(F.col("class") == "forwarded").alias("valid"), F.count_if(F.col("class") == "bad_signature").alias("bad"))


def gossip(announces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexers, endorsements) of announces(peer, seq, pubkey binary, endorsed array<binary>).

    A key of 32 bytes that aren't all zero makes its peer an indexer, labelled by the peer. Of an
    announcement's first MOST_ENDORSED endorsements those of other such keys count; without an own
    key none does.
    """
    good = lambda c: F.coalesce((F.octet_length(c) == 32) & (c != F.lit(bytes(32))), F.lit(False))
    rows = announces.filter(good(F.col("pubkey")))
    indexers = rows.groupBy("pubkey").agg(F.min_by("peer", F.struct("seq", "peer")).alias("peer")).select(F.lower(F.hex("pubkey")).alias("publisher"), F.concat(F.lit("gossip:"), "peer").alias("label"))
    named = rows.select("pubkey", F.explode(F.slice("endorsed", 1, MOST_ENDORSED)).alias("candidate"))
    edges = named.filter(good(F.col("candidate")) & (F.col("candidate") != F.col("pubkey")))
    return indexers, edges.select(F.lower(F.hex("pubkey")).alias("endorser"), F.lower(F.hex("candidate")).alias("candidate")).distinct()


def confirmed(known_good: DataFrame, transfers: DataFrame, trusted: DataFrame) -> DataFrame:
    """Known-good infohashes after new transfers(infohash, complete, signed_by): complete ones and those that a trusted publisher signed are added."""
    keys = trusted.select(F.lower("publisher").alias("signed_by")).distinct()
    rows = transfers.select(F.lower("infohash").alias("infohash"), "complete", F.lower("signed_by").alias("signed_by"))
    signed = rows.join(keys, "signed_by", "left_semi").select("infohash")
    return known_good.select(F.lower("infohash").alias("infohash")).union(rows.filter("complete").select("infohash")).union(signed).distinct()


def round_of(followed: DataFrame, pointers: DataFrame, payloads: DataFrame, local: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(chunks, results) of one subscriber round.

    followed: publisher; pointers: publisher, snapshot; payloads: snapshot and the rows of nested();
    local: chunks as documents.CHUNKS. A snapshot that a followed publisher points at is ingested
    whole, whether it was before or not: its chunks replace those of equal keys. results:
    publisher, state (synced, no_pointer, no_payload) and the torrents and chunks that it brought.
    """
    asked = followed.select("publisher").distinct().join(pointers.select("publisher", "snapshot"), "publisher", "left")
    got = asked.join(payloads, "snapshot", "left")
    rows = got.filter("infohash is not null")
    counts = rows.groupBy("publisher").agg(F.count("*").alias("torrents"), F.sum(F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + F.size(f.chunks))).alias("chunks"))
    state = F.when(F.col("snapshot").isNull(), "no_pointer").when(F.col("torrents").isNull(), "no_payload").otherwise("synced")
    results = asked.join(counts, "publisher", "left").select("publisher", state.alias("state"), F.coalesce("torrents", F.lit(0)).alias("torrents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    files = rows.select("infohash", F.explode("files").alias("f")).select("infohash", "f.*")
    new = files.select("infohash", F.col("index").alias("file_index"), F.col("path").alias("file_path"), F.col("size").alias("file_size"), "mime", "extractor", F.posexplode("chunks").alias("chunk_index", "c"))
    new = new.select("infohash", "file_index", "file_path", "file_size", "mime", F.col("c.text").alias("text"), "extractor", now.alias("indexed_at"), "chunk_index")
    return documents.upsert_chunks(local, new), results


def fetched_path(folder: str, name: str) -> str:
    """Where a followed snapshot's single file lies; names that leave the folder raise ValueError."""
    if not name or "/" in name or name in (".", ".."):
        raise ValueError("snapshot name")
    return f"{folder.rstrip('/')}/{name}"


def fetched(spark, folder: str, name: str) -> DataFrame:
    """The torrents of a fetched snapshot, checked as read_snapshot() does."""
    return snapshot.read_snapshot(spark, fetched_path(folder, name))
