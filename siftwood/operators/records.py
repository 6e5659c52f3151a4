"""Signed keyword records: identity, filters, proof of work, prefix queries, paged files."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwood.functions import bencode, ed25519
from siftwood.session import spread

SCHEMA = "pk binary, kw string, ih binary, t bigint, pow bigint, sig binary"
#: Bounds of a record.
MAX_KEYWORD, MAX_RECORD = 64, 256


def le64(n: Column) -> Column:
    """Eight bytes of a long, the lowest first."""
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def identity(pk: Column, kw: Column, ih: Column, t: Column) -> Column:
    """SHA-256 of key, keyword, infohash and time, in hex; proof and signature don't count."""
    return F.sha2(F.concat(pk, kw.cast("binary"), ih, le64(t)), 256)


def well_formed(records: DataFrame) -> DataFrame:
    """Records whose fields have their lengths."""
    return records.filter((F.octet_length("pk") == 32) & (F.octet_length("ih") == 20) & (F.octet_length("sig") == 64) & F.octet_length("kw").between(1, MAX_KEYWORD))


def selected(records: DataFrame, publishers: list[str] | None = None, since: int | None = None, prefix: str | None = None) -> DataFrame:
    """Records by publisher, time and keyword prefix, all optional. Malformed keys are ignored; if none is left that test is off."""
    keys = [bytes.fromhex(p) for p in publishers or [] if len(p) == 64 and set(p.lower()) <= set("0123456789abcdef")]
    if keys:
        records = records.filter(F.col("pk").isin(keys))
    if since is not None:
        records = records.filter(F.col("t") >= since)
    return records.filter(F.col("kw").startswith(prefix)) if prefix else records


def distinct_records(records: DataFrame) -> DataFrame:
    """One record of each identity, the last by time of arrival (seq)."""
    rows = records.withColumn("id", identity(F.col("pk"), F.col("kw"), F.col("ih"), F.col("t")))
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")


#: What the records of one list share.
SHARED = ["pk", "ih", "t"]


def merged_lists(lists: DataFrame, facts: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Rows (pk, kw, ih, t, facts) of lists(pk, ih, t, kws, facts): every record once, with the facts of its lists combined.

    A list stands for a record of each of its keywords. Equal records lie in lists of one key, infohash and time, so lists are shuffled
    and records aren't: only where such lists differ are their records combined one by one, beside each other. facts: by column, an
    aggregate that may be applied again to its own results (max, bit_or). Lists with a null among pk, ih and t have no records.
    """
    combined = lambda: [f(c).alias(c) for c, f in facts.items()]
    whole = lists.dropna(subset=SHARED).filter(F.size("kws") > 0).select(*SHARED, F.array_distinct("kws").alias("kws"), *facts)
    whole = whole.repartition(*SHARED).groupBy(*SHARED, "kws").agg(*combined()).withColumn("lists", F.count("*").over(Window.partitionBy(*SHARED)))
    rows = lambda some: whole.filter(some).select(*SHARED, *facts, F.explode("kws").alias("kw"))
    alone, several = rows("lists = 1"), rows("lists > 1").groupBy(*SHARED, "kw").agg(*combined())
    return alone.unionByName(several)


def distinct_in_lists(lists: DataFrame) -> DataFrame:
    """Rows (id, seq) of lists(pk, ih, t, kws, seq): the identities that distinct_records() finds, each with its last arrival. Records without an identity are one."""
    named = merged_lists(lists, {"seq": F.max}).select(identity(F.col("pk"), F.col("kw"), F.col("ih"), F.col("t")).alias("id"), "seq")
    none = lists.filter((F.col("pk").isNull() | F.col("ih").isNull() | F.col("t").isNull()) & (F.size("kws") > 0))
    none = none.agg(F.max("seq").alias("seq"), F.count("*").alias("n")).filter("n > 0")
    return named.unionByName(none.select(F.lit(None).cast("string").alias("id"), "seq"))


def sides_of_lists(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows (id, sides) of two sets of records, as lists(pk, ih, t, kws): 1 only local, 2 only remote, 3 both."""
    side = lambda lists, n: lists.select(*SHARED, "kws", F.lit(n).alias("sides"))
    rows = merged_lists(side(local, 1).union(side(remote, 2)), {"sides": F.bit_or})
    return rows.select(identity(F.col("pk"), F.col("kw"), F.col("ih"), F.col("t")).alias("id"), "sides")


def difference_of_lists(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows (id, side) as sketches.set_difference() has them, of two sets of records as lists(pk, ih, t, kws)."""
    return sides_of_lists(local, remote).filter("sides < 3").select("id", F.when(F.col("sides") == 2, "added").otherwise("removed").alias("side"))


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def message(pk: bytes, kw: str, ih: bytes, t: int, pow_: int) -> bytes:
    """What a record's signature and proof of work cover."""
    return bytes(pk) + kw.encode() + bytes(ih) + struct.pack("<q", t) + uvarint(pow_ % (1 << 64))


def zero_bits(digest: bytes) -> int:
    """Leading zero bits."""
    return len(digest) * 8 - int.from_bytes(digest, "big").bit_length()


def mined(pk: bytes, kw: str, ih: bytes, t: int, bits: int) -> int:
    """The first nonce whose message hash has so many leading zero bits; above 40 bits raises ValueError."""
    if bits > 40:
        raise ValueError("proof of work above 40 bits")
    nonce = 0
    while zero_bits(hashlib.sha256(message(pk, kw, ih, t, nonce)).digest()) < bits:
        nonce += 1
    return nonce


def encoded(pk: bytes, kw: str, ih: bytes, t: int, pow_: int, sig: bytes) -> bytes:
    if not 1 <= len(kw.encode()) <= MAX_KEYWORD:
        raise ValueError("keyword length")
    out = bencode.encode({"pk": bytes(pk), "kw": kw, "ih": bytes(ih), "t": t, "pow": pow_ % (1 << 64), "sig": bytes(sig)})
    if len(out) > MAX_RECORD:
        raise ValueError("record length")
    return out


def decoded(data: bytes) -> tuple:
    d = bencode.decode(data)
    pk, kw, ih, sig = d[b"pk"], d[b"kw"], d[b"ih"], d[b"sig"]
    if (len(pk), len(ih), len(sig)) != (32, 20, 64) or not 1 <= len(kw) <= MAX_KEYWORD or len(data) > MAX_RECORD:
        raise ValueError("field length")
    return pk, kw.decode(), ih, d[b"t"], d[b"pow"], sig


_Q = "pk binary, kw string, ih binary, t bigint, pow bigint, sig binary"


def signed(rows: DataFrame, seed: bytes, bits: int = 0) -> DataFrame:
    """rows(kw, ih, t) as signed records of one publisher, with proof of work if bits is above 0."""
    pk = ed25519.public_key(seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            nonces = [mined(pk, kw, ih, t, bits) if bits else 0 for kw, ih, t in zip(f.kw, f.ih, f.t, strict=True)]
            texts = [message(pk, *x) for x in zip(f.kw, f.ih, f.t, nonces, strict=True)]
            yield pd.DataFrame({"pk": [pk] * len(f), "kw": f.kw, "ih": f.ih, "t": f.t, "pow": nonces, "sig": ed25519.sign_all(seed, texts)})

    return spread(rows.select("kw", "ih", "t")).mapInPandas(run, _Q)


def verified(records: DataFrame, min_bits: int = 0, signatures: bool = True) -> DataFrame:
    """Records with enough proof of work, a cheap test that comes first, and a valid signature."""
    records = well_formed(records)
    columns = records.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [message(*x) for x in zip(f["pk"], f["kw"], f["ih"], f["t"], f["pow"], strict=True)]
            keep = [zero_bits(hashlib.sha256(m).digest()) >= min_bits for m in texts]
            if signatures:
                valid = iter(ed25519.verify_all([x for x, k in zip(zip(f["pk"], texts, f["sig"], strict=True), keep, strict=True) if k]))
                keep = [k and next(valid) for k in keep]
            yield f[keep]

    return records.mapInPandas(run, records.select(*columns).schema)


def in_order(records: DataFrame) -> DataFrame:
    """Records range-partitioned and sorted by keyword and infohash bytes; ties by key and time."""
    keys = ["kw", "ih", "pk", "t"]
    return records.repartitionByRange("kw", "ih").sortWithinPartitions(*keys)


def write_sorted(records: DataFrame, path: str) -> None:
    """The record table: sorted files, so that a prefix reads only the row groups whose bounds meet it."""
    in_order(records).write.mode("overwrite").parquet(path)


def find(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Records whose keyword starts with a prefix, in key order; the test is pushed to the scan."""
    return spark.read.parquet(path).filter(F.col("kw").startswith(prefix)).orderBy("kw", "ih", "pk", "t")


def fingerprint(records: DataFrame) -> str:
    """SHA-256 over the encoded records in key order. Partitions stream to the driver one at a time, in order."""
    h = hashlib.sha256()
    for r in records.orderBy("kw", "ih", "pk", "t").toLocalIterator():
        h.update(encoded(r.pk, r.kw, r.ih, r.t, r.pow, r.sig))
    return h.hexdigest()


def range_fingerprints(records: DataFrame) -> DataFrame:
    """A row per range of the sorted records: range, first keyword, n, sha256 of its encoded records. Nothing but these rows leaves the tasks."""
    rows = in_order(records).select("pk", "kw", "ih", "t", "pow", "sig").withColumn("range", F.spark_partition_id())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, n, first, number = hashlib.sha256(), 0, None, 0
        for f in frames:
            for r in f.itertuples(index=False):
                h.update(encoded(bytes(r.pk), r.kw, bytes(r.ih), int(r.t), int(r.pow), bytes(r.sig)))
                first, number, n = r.kw if first is None else first, int(r.range), n + 1
        if n:
            yield pd.DataFrame([(number, first, n, h.hexdigest())], columns=["range", "first", "n", "sha256"])

    return rows.mapInPandas(run, "range int, first string, n long, sha256 string")


def fingerprint_of_file(records: DataFrame) -> str:
    """The fingerprint as one paged file of a small set has it."""
    rows = [(bytes(r.pk), r.kw, bytes(r.ih), r.t, r.pow, bytes(r.sig)) for r in records.collect()]
    return trailer(tree_file(rows, bytes(32), 1, 0))["fingerprint"].hex()


# Fixed values of the paged file.
MAGIC, PAGE_VERSION, HEADER = b"SNAGG\x00", 1, 16
ROOT, INTERIOR, LEAF, TRAILER = 0x00, 0x01, 0x02, 0xFF
_TRAILER = struct.Struct("<B32sQQIIQB32s")


def page(kind: int, level: int, payload: bytes, size: int) -> bytes:
    if len(payload) > min(65535, size - HEADER):
        raise ValueError("page overflow")
    return (MAGIC + struct.pack("<BBBBH", PAGE_VERSION, kind, level, 0, len(payload)) + bytes(4) + payload).ljust(size, b"\0")


def opened(data: bytes) -> tuple[int, int, bytes]:
    """(kind, level, payload) of a page."""
    if len(data) < HEADER or data[:6] != MAGIC or data[6] != PAGE_VERSION:
        raise ValueError("bad page header")
    version, kind, level, _, n = struct.unpack_from("<BBBBH", data, 6)
    if HEADER + n > len(data):
        raise ValueError("bad page length")
    return kind, level, data[HEADER : HEADER + n]


def _read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def _items(payload: bytes, tail: int) -> list[tuple[bytes, bytes]]:
    """Length-prefixed items of a page, each with `tail` bytes behind it."""
    out, at = [], 2
    for _ in range(struct.unpack_from("<H", payload)[0]):
        n, at = _read_uvarint(payload, at)
        if at + n + tail > len(payload):
            raise ValueError("cut page")
        out.append((payload[at : at + n], payload[at + n : at + n + tail]))
        at += n + tail
    return out


def tree_file(records: list[tuple], seed: bytes, seq: int, created: int, page_size: int = 16 << 10, min_bits: int = 0) -> bytes:
    """A signed paged tree of records (pk, kw, ih, t, pow, sig): root first, levels down to the leaves, trailer last.

    For sets that fit one file; large tables stay in sorted Parquet.
    """
    if not records:
        raise ValueError("no records")
    rows = sorted(records, key=lambda r: (r[1].encode() + b"\0" + bytes(r[2]), bytes(r[0]), r[3]))
    codes = [encoded(*r) for r in rows]

    def packed(items: list[bytes]) -> list[tuple[int, int]]:
        runs, start, used = [], 0, 2
        for i, x in enumerate(items):
            if i > start and HEADER + used + len(x) > page_size or used + len(x) > 65535:
                runs.append((start, i))
                start, used = i, 2
            used += len(x)
        return runs + [(start, len(items))]

    framed = [uvarint(len(c)) + c for c in codes]
    levels = [[(rows[a][1].encode() + b"\0" + bytes(rows[a][2]), struct.pack("<H", b - a) + b"".join(framed[a:b])) for a, b in packed(framed)]]
    children: list[list[tuple[int, int]]] = []
    while not children or len(levels[-1]) > 1:
        below = [uvarint(len(k)) + k + bytes(4) for k, _ in levels[-1]]
        runs = packed(below)
        children.append(runs)
        levels.append([(levels[-1][a][0], b"") for a, _ in runs])
    levels.reverse()
    children.reverse()
    starts = [sum(map(len, levels[:i])) for i in range(len(levels) + 1)]
    pages = []
    for depth, level in enumerate(levels):
        up = len(levels) - 1 - depth
        for i, (_, payload) in enumerate(level):
            if up:
                a, b = children[depth][i]
                below = levels[depth + 1][a:b]
                payload = struct.pack("<H", b - a) + b"".join(uvarint(len(k)) + k + struct.pack("<I", starts[depth + 1] + a + j) for j, (k, _) in enumerate(below))
            pages.append(page(LEAF if not up else ROOT if not depth else INTERIOR, up, payload, page_size))
    fields = _TRAILER.pack(1, ed25519.public_key(seed), seq, created, 0, len(pages) + 1, len(rows), min_bits, hashlib.sha256(b"".join(codes)).digest())
    pages.append(page(TRAILER, 0, fields + ed25519.sign(seed, fields), page_size))
    return b"".join(pages)


def trailer(data: bytes, page_size: int = 16 << 10) -> dict:
    """The checked trailer of a paged tree."""
    kind, _, payload = opened(data[-page_size:])
    names = ("version", "pk", "seq", "created", "root", "pages", "records", "min_bits", "fingerprint")
    out = dict(zip(names, _TRAILER.unpack(payload[: _TRAILER.size]), strict=True))
    if kind != TRAILER or len(data) < 3 * page_size or out["pages"] * page_size != len(data) or out["root"] or not ed25519.verify(out["pk"], payload[: _TRAILER.size], payload[_TRAILER.size :]):
        raise ValueError("bad trailer")
    return out


def tree_find(data: bytes, prefix: str, page_size: int = 16 << 10) -> list[tuple]:
    """Valid records of a paged tree whose keyword starts with prefix; subtrees outside its key range aren't read."""
    from siftwood.functions.text import next_prefix

    facts, low = trailer(data, page_size), prefix.encode()
    high, out = next_prefix(low), []

    def walk(i: int) -> None:
        kind, _, payload = opened(data[i * page_size : (i + 1) * page_size])
        if kind == LEAF:
            for code, _ in _items(payload, 0):
                r = decoded(code)
                m = message(*r[:5])
                if r[1].encode().startswith(low) and ed25519.verify(r[0], m, r[5]) and zero_bits(hashlib.sha256(m).digest()) >= facts["min_bits"]:
                    out.append(r)
            return
        below = _items(payload, 4)
        for j, (key, at) in enumerate(below):
            after = below[j + 1][0] if j + 1 < len(below) else None
            if (high is None or key < high or j == 0) and (after is None or after >= low):
                walk(struct.unpack("<I", at)[0])

    walk(0)
    return out


def tree_query(records: DataFrame, prefix: str, seed: bytes = bytes(32), page_size: int = 16 << 10, min_bits: int = 0) -> DataFrame:
    """Valid records whose keyword starts with prefix, from paged trees: one tree a range of keywords, built and read in its task."""
    rows = in_order(well_formed(records)).select("pk", "kw", "ih", "t", "pow", "sig")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for f in frames for r in f.itertuples(index=False)]
        if held:
            tree = tree_file([(bytes(pk), kw, bytes(ih), int(t), int(p), bytes(sig)) for pk, kw, ih, t, p, sig in held], seed, 1, 0, page_size, min_bits)
            yield pd.DataFrame(tree_find(tree, prefix, page_size), columns=["pk", "kw", "ih", "t", "pow", "sig"])

    return rows.mapInPandas(run, _Q)


def tree_records(data: bytes, page_size: int = 16 << 10) -> tuple[list[tuple], bool]:
    """All records of a paged tree in order, and whether they match its fingerprint."""
    facts, codes = trailer(data, page_size), []
    for i in range(len(data) // page_size):
        kind, _, payload = opened(data[i * page_size : (i + 1) * page_size])
        if kind == LEAF:
            codes += [c for c, _ in _items(payload, 0)]
    return [decoded(c) for c in codes], hashlib.sha256(b"".join(codes)).digest() == facts["fingerprint"]


def minted(names: DataFrame, seed: bytes, now: int) -> DataFrame:
    """Signed records, without proof of work, of all keywords of names(infohash, name)."""
    from siftwood.functions.text import keywords

    rows = names.select(F.explode(keywords(F.col("name"), None)).alias("kw"), F.unhex("infohash").alias("ih"), F.lit(now).cast("long").alias("t"))
    return signed(rows.filter(F.octet_length("kw") <= MAX_KEYWORD), seed)
