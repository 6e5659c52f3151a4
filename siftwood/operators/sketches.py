"""Known-good filters (Bloom) and rateless set reconciliation."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

# Fixed values of the hashes and of the filter's file.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BLOOM_MAGIC, BLOOM_VERSION = b"SBLM", 1
LEVELS, SYMBOL_BUDGET = 12, 2000


def fnv(items: list[bytes], start: np.ndarray | None = None) -> np.ndarray:
    """64-bit FNV-1a of each item, going on from start if given."""
    h = np.full(len(items), FNV_START, np.uint64) if start is None else start.copy()
    size = np.array([len(x) for x in items])
    width = int(size.max(initial=0))
    data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in items), np.uint8).reshape(len(items), width) if width else np.zeros((len(items), 0), np.uint8)
    for i in range(width):
        live = size > i
        h[live] = (h[live] ^ data[live, i]) * np.uint64(FNV_PRIME)
    return h


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """(bits, probes) for n items at a false-positive rate.

    Bits are odd. The second hash is a multiple of the first modulo powers of two, so the probes that follow from both would miss most of the
    bits of an even number of them.
    """
    bits = max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2)) | 1
    return bits, max(1, math.ceil(bits / n * math.log(2)))


def probes(items: list[bytes], bits: int, k: int) -> np.ndarray:
    h1 = fnv(items)
    h2 = fnv([b"\xff"] * len(items), h1)
    return (h1[:, None] + np.arange(k, dtype=np.uint64) * h2[:, None]) % np.uint64(bits)


def bloom_words(items: DataFrame, bits: int, k: int) -> DataFrame:
    """The filter of items(item binary): rows (word, value) of its words that aren't zero; words of all tasks are or-ed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.unique(probes([bytes(x) for x in f["item"].dropna()], bits, k))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            if len(at):
                yield pd.DataFrame({"word": word.astype(np.int64), "value": np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start).view(np.int64)})

    return items.select("item").mapInPandas(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))


def bloom_array(words: DataFrame, bits: int) -> np.ndarray:
    """The filter's words on the driver; their number is fixed by the filter's size."""
    out = np.zeros((bits + 63) // 64, np.uint64)
    f = words.toPandas()
    out[f["word"].to_numpy()] = f["value"].to_numpy().view(np.uint64)
    return out


#: Largest filter, in bits (32 MB), that is sent to every task; larger ones are met by a join.
SENT_BITS = 1 << 28


def bloom_test(words: np.ndarray, bits: int, k: int):
    """A column function: whether an item may be in the filter. Filters above SENT_BITS raise ValueError; bloom_flagged() takes any."""
    if bits > SENT_BITS:
        raise ValueError("filter is too large to be sent to tasks")

    @pandas_udf("boolean")
    def test(item: pd.Series) -> pd.Series:
        known = item.notna()
        at = probes([bytes(x) if x is not None else b"" for x in item], bits, k)
        hit = ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)
        return pd.Series(hit & known.to_numpy())

    return test


def bloom_flagged(items: DataFrame, filter_words: DataFrame, bits: int, k: int) -> DataFrame:
    """items(item binary, ...) with maybe: whether the filter may hold the item. Null items are never held.

    Filters up to SENT_BITS go to the tasks; of larger ones each probe meets its word by an equi-join.
    """
    if bits <= SENT_BITS:
        return items.withColumn("maybe", bloom_test(bloom_array(filter_words, bits), bits, k)("item"))

    @pandas_udf("array<long>")
    def places(item: pd.Series) -> pd.Series:
        return pd.Series(list(probes([bytes(x) if x is not None else b"" for x in item], bits, k).astype(np.int64)))

    asked = items.select("item").distinct().filter("item is not null").select("item", F.explode(places("item")).alias("at"))
    asked = asked.select("item", F.shiftright("at", 6).alias("word"), F.expr("at & 63").cast("int").alias("bit"))
    held = asked.join(filter_words, "word", "left").groupBy("item").agg(F.min(F.expr("shiftright(coalesce(value, 0L), bit) & 1")).alias("held"))
    return items.join(held, "item", "left").withColumn("maybe", F.coalesce(F.col("held") == 1, F.lit(False))).drop("held")


def bloom_estimate(words: DataFrame, bits: int, k: int) -> DataFrame:
    """One row: set bits and the estimated number of items (infinite for a full filter)."""
    ones = F.coalesce(F.sum(F.bit_count("value")), F.lit(0))
    return words.agg(ones.alias("ones")).withColumn("items", F.when(F.col("ones") >= bits, F.lit(float("inf"))).otherwise(-F.lit(bits / k) * F.log(F.lit(1.0) - F.col("ones") / F.lit(float(bits)))))


def bloom_bytes(words: np.ndarray, bits: int, k: int) -> bytes:
    return BLOOM_MAGIC + struct.pack("<HHQQ", BLOOM_VERSION, k, bits, len(words)) + words.astype("<u8").tobytes()


def bloom_from(data: bytes) -> tuple[np.ndarray, int, int]:
    """(words, bits, probes) of a filter file; inconsistent ones raise ValueError."""
    if len(data) < 24 or data[:4] != BLOOM_MAGIC:
        raise ValueError("not a filter file")
    version, k, bits, n = struct.unpack_from("<HHQQ", data, 4)
    if version != BLOOM_VERSION or not k or not bits or n != (bits + 63) // 64 or len(data) != 24 + 8 * n:
        raise ValueError("inconsistent filter file")
    return np.frombuffer(data, "<u8", n, 24).astype(np.uint64), bits, k


def contributes(keys: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Which keys take part in a symbol: a share of 2**-(1 + symbol mod 12), by a splitmix finaliser. One of both may be an array."""
    symbol = np.asarray(symbol).astype(np.uint64)
    z = keys + symbol * np.array(MIX[0], np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[2])
    return (z ^ (z >> np.uint64(31))) % (np.uint64(1) << (np.uint64(1) + symbol % np.uint64(LEVELS))) == 0


def symbols(ids: DataFrame, first: int, count: int) -> DataFrame:
    """Symbols first.. of a set ids(id binary(32)): symbol, count, key xor and the xor of ids in four lanes.

    Each task adds its members to all symbols asked for; a row per symbol and task is shuffled.
    """
    lanes = [f"lane{i}" for i in range(4)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((count, 6), np.uint64)
        for f in frames:
            raw = [bytes(x) for x in f["id"]]
            key = fnv(raw)
            lane = np.frombuffer(b"".join(raw), "<u8").reshape(-1, 4)
            for s in range(count):
                on = contributes(key, first + s)
                total[s, 0] += np.uint64(on.sum())
                total[s, 1] ^= np.bitwise_xor.reduce(key[on])
                total[s, 2:] ^= np.bitwise_xor.reduce(lane[on], axis=0)
        yield pd.DataFrame({"symbol": np.arange(first, first + count)} | {c: total[:, i].astype(np.int64) if not i else total[:, i].view(np.int64) for i, c in enumerate(["n", "key", *lanes])})

    made = ids.select("id").mapInPandas(run, "symbol long, n long, key long, " + ", ".join(f"{c} long" for c in lanes))
    return made.groupBy("symbol").agg(F.sum("n").alias("n"), *[F.expr(f"bit_xor({c})").alias(c) for c in ["key", *lanes]])


def peeled(diff: np.ndarray) -> tuple[list[bytes], list[bytes], bool]:
    """(only remote, only local, complete) from differences of symbols: rows (count, key, lanes) of remote minus local."""
    count, rest = diff[:, 0].astype(np.int64), diff[:, 1:].astype(np.uint64).copy()
    found: dict[bytes, int] = {}
    progress = True
    while progress:
        progress = False
        for s in np.flatnonzero(np.abs(count) == 1):
            item = rest[s, 1:].astype("<u8").tobytes()
            key = fnv([item])
            if abs(count[s]) != 1 or key[0] != rest[s, 0] or not contributes(key, s)[0] or item in found:
                continue
            sign = int(count[s])
            found[item], progress = sign, True
            on = contributes(key, np.arange(len(count)))
            count[on] -= sign
            rest[on] ^= np.concatenate([key, np.frombuffer(item, "<u8").astype(np.uint64)])
    done = not count.any() and not rest.any()
    return sorted(x for x, s in found.items() if s > 0), sorted(x for x, s in found.items() if s < 0), done


def reconciled(local: DataFrame, remote: DataFrame, batch: int = 100, budget: int = SYMBOL_BUDGET) -> tuple[list[bytes], list[bytes], int]:
    """(only remote, only local, symbols used) of two sets of 32-byte ids by exchanging symbols until all peel.

    State on the driver grows with the difference only; a difference beyond the budget raises
    ValueError, and reconciled_ranges() and set_difference() serve any size.
    """
    columns, have = ["n", "key", "lane0", "lane1", "lane2", "lane3"], np.zeros((0, 6), np.int64)
    while len(have) < budget:
        sides = [symbols(x, len(have), batch).orderBy("symbol").toPandas()[columns].to_numpy() if not x.isEmpty() else np.zeros((batch, 6), np.int64) for x in (remote, local)]
        step = sides[1] ^ sides[0]
        step[:, 0] = sides[0][:, 0] - sides[1][:, 0]
        have = np.concatenate([have, step])
        view = have.copy().view(np.uint64)
        added, removed, done = peeled(view)
        if done:
            return added, removed, len(have)
    raise ValueError("symbol budget is used up")


def reconciled_ranges(local: DataFrame, remote: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (id, side) of two sets of 32-byte ids, as set_difference() gives them, by exchanging symbols of hash ranges; see reconcile.rateless()."""
    from siftwood.operators.reconcile import rateless

    return rateless(local, remote, ranges)[0]


def set_difference(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Rows (key, side): added (only remote) and removed (only local). Each side is read once, and keys are combined before the one shuffle; nulls are no keys."""
    both = local.select(key, F.lit(1).alias("_s")).union(remote.select(key, F.lit(2).alias("_s"))).filter(F.col(key).isNotNull())
    return both.groupBy(key).agg(F.bit_or("_s").alias("_s")).filter("_s < 3").select(key, F.when(F.col("_s") == 2, "added").otherwise("removed").alias("side"))


def answered_needs(needs: DataFrame, records: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(found records, missing ids) of a request."""
    ids = needs.select(key).distinct()
    return records.join(ids, key, "left_semi"), ids.join(records.select(key), key, "left_anti")


def element(label: str) -> bytes:
    return hashlib.sha256(label.encode()).digest()


#: Most symbols, records and ids of one message of a session.
SYMBOLS_SENT, RECORDS_SENT, IDS_SENT = 100, 500, 1000


def messages(rows: DataFrame, most: int) -> DataFrame:
    """rows dealt to messages of at most so many: with message, a number that is its own in each partition's range."""
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, n = TaskContext.get().partitionId() << 40, 0
        for f in frames:
            yield f.assign(message=first + (np.arange(n, n + len(f)) // most))[[*columns, "message"]]
            n += len(f)

    return rows.mapInPandas(run, StructType([*rows.schema]).add("message", "long"))


def session(local: DataFrame, remote: DataFrame, records: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(asked, answered) of a session in which local fetches what only remote has.

    asked: ids that local lacks, in messages of IDS_SENT; answered: the records of those ids, in
    messages of RECORDS_SENT.
    """
    lacking = set_difference(local, remote, key).filter("side = 'added'").select(key)
    found, _ = answered_needs(lacking, records, key)
    return messages(lacking, IDS_SENT), messages(found, RECORDS_SENT)
