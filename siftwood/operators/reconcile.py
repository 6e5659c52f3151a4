"""Rateless reconciliation of two large sets: symbols of hash ranges, folded where the ids are, as many as each range needs.

A task adds its ids to the first symbols of all ranges and passes on the symbols, not the ids: what is shuffled depends on
ranges and symbols, and hardly on the sets. A range peels on with what it had found before whenever it
gets more symbols, at least twice as many as before and as many as its empty symbols suggest, until its difference is found; ids meet only
where that doesn't pay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.operators.records import SHARED, difference_of_lists, le64
from siftwood.operators.sketches import LEVELS, contributes, fnv, set_difference
from siftwood.session import spread, work_dir

#: Ids of both sides for each hash range, on average, and the most ranges; a task holds the symbols of all of them.
RANGE_IDS, MOST_RANGES = 2048, 16_384
#: Symbols of a range in the first round, and at most; ids folded at once.
FIRST_SYMBOLS, MOST_SYMBOLS, FOLD_IDS = 32, 2048, 1 << 16
WORDS = 6  # of a symbol: count, key, four lanes of the id


def _folded(both: DataFrame, ranges: int, first: int, last: int, wanted: list[int] | None) -> DataFrame:
    """Rows (range, symbols) of both(id, sign): what the ids of a task add to the symbols first to last - 1 of each range, and to the sum of the whole range behind them."""
    keep = None if wanted is None else np.isin(np.arange(ranges), wanted)
    width = last - first + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((ranges if keep is None else int(keep.sum()), width, WORDS), np.uint64)
        place = np.arange(ranges) if keep is None else np.cumsum(keep) - 1
        seen = np.zeros(ranges, bool)

        def fold(raw: list[bytes], sign: np.ndarray) -> None:
            keys = fnv(raw)
            at = ((keys >> np.uint64(20)) % np.uint64(ranges)).astype(np.int64)
            values = np.column_stack([sign.astype(np.int64).view(np.uint64), keys, np.frombuffer(b"".join(raw), "<u8").reshape(-1, 4)])
            if keep is not None:
                use = keep[at]
                at, keys, values = at[use], keys[use], values[use]
            order = np.argsort(at, kind="stable")
            at, keys, values = place[at[order]], keys[order], values[order]
            seen[np.unique(at)] = True
            for s in range(width):
                on = slice(None) if s == width - 1 else np.flatnonzero(contributes(keys, first + s))
                rows = at[on]
                if len(rows):
                    start = np.flatnonzero(np.diff(rows, prepend=-1))
                    total[rows[start], s, 0] += np.add.reduceat(values[on, 0], start)
                    total[rows[start], s, 1:] ^= np.bitwise_xor.reduceat(values[on, 1:], start, axis=0)

        raw, sign = [], []
        for f in frames:
            raw += [bytes(x) for x in f["id"]]
            sign.append(f["sign"].to_numpy())
            if len(raw) >= FOLD_IDS:
                fold(raw, np.concatenate(sign))
                raw, sign = [], []
        if raw:
            fold(raw, np.concatenate(sign))
        names = np.arange(ranges) if keep is None else np.flatnonzero(keep)
        for r in np.flatnonzero(seen[: len(names)]):
            yield pd.DataFrame({"range": [int(names[r])], "symbols": [total[r].tobytes()]})

    return both.mapInPandas(run, "range long, symbols binary")


def peel(count: np.ndarray, rest: np.ndarray, found: dict[bytes, int], first: int) -> None:
    """Peel differences of symbols (counts, and keys with lanes), in place, going on from what was found before; symbols from `first` on still hold that."""
    if found and first < len(count):
        ids = list(found)
        keys, lanes, sign = fnv(ids), np.frombuffer(b"".join(ids), "<u8").reshape(-1, 4), np.array(list(found.values()))
        for s in range(first, len(count)):
            on = contributes(keys, s)
            count[s] -= sign[on].sum()
            rest[s, 0] ^= np.bitwise_xor.reduce(keys[on])
            rest[s, 1:] ^= np.bitwise_xor.reduce(lanes[on], axis=0)
    every, waiting = np.arange(len(count)), list(np.flatnonzero(np.abs(count) == 1))
    while waiting:
        s = waiting.pop()
        if abs(count[s]) != 1:
            continue
        item = rest[s, 1:].astype("<u8").tobytes()
        key = fnv([item])
        if key[0] != rest[s, 0] or item in found or not contributes(key, s)[0]:
            continue
        sign = int(count[s])
        found[item] = sign
        on = contributes(key, every)
        count[on] -= sign
        rest[on] ^= np.concatenate([key, np.frombuffer(item, "<u8").astype(np.uint64)])
        waiting += list(np.flatnonzero(on & (np.abs(count) == 1)))


def guessed(count: np.ndarray, rest: np.ndarray) -> int:
    """How many items are left in symbols: the share that takes part halves from one level to the next, until half of a level's symbols are empty."""
    empty = (count == 0) & ~rest.any(1)
    for level in range(LEVELS):
        if empty[level::LEVELS].mean() >= 0.5:
            return 1 << level
    return 1 << LEVELS


def _peeled(parts: DataFrame, first: int, last: int) -> DataFrame:
    """A row per range and round: range, n (symbols so far), done, found (ids, then their signs), rest (what is left of the symbols) and about how many items that holds."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        new, state = np.zeros((last - first + 1, WORDS), np.uint64), None
        for symbols, found, rest in zip(f["symbols"], f["found"], f["rest"], strict=True):
            if rest is not None:
                state = (found, rest)
                continue
            x = np.frombuffer(symbols, np.uint64).reshape(-1, WORDS)
            new[:, 0] += x[:, 0]
            new[:, 1:] ^= x[:, 1:]
        symbols, held = new[:-1], {}
        if state is not None:
            symbols = np.concatenate([np.frombuffer(state[1], np.uint64).reshape(-1, WORDS), symbols])
            n = len(state[0]) // 33
            held = {state[0][32 * i : 32 * i + 32]: s for i, s in enumerate(np.frombuffer(state[0][32 * n :], np.int8).tolist())}
        count, rest = symbols[:, 0].copy().view(np.int64), symbols[:, 1:].copy()
        peel(count, rest, held, first)
        done = not count.any() and not rest.any()
        if done:  # the sum of the range tells whether that is all
            ids = list(held)
            sums = np.bitwise_xor.reduce(np.column_stack([fnv(ids), np.frombuffer(b"".join(ids), "<u8").reshape(-1, 4)]), axis=0) if ids else np.zeros(5, np.uint64)
            done = sum(held.values()) == int(new[-1, :1].view(np.int64)[0]) and bool((sums == new[-1, 1:]).all())
        left = b"" if done else np.column_stack([count.view(np.uint64), rest]).tobytes()
        return pd.DataFrame({"range": [int(key[0])], "n": [last], "done": [done], "found": [b"".join(held) + np.array(list(held.values()), np.int8).tobytes()], "rest": [left], "about": [0 if done else guessed(count, rest)]})

    return parts.groupBy("range").applyInPandas(run, "range long, n int, done boolean, found binary, rest binary, about long")


def rateless(local: DataFrame, remote: DataFrame, ranges: int | None = None, first: int = FIRST_SYMBOLS, most: int = MOST_SYMBOLS) -> tuple[DataFrame, DataFrame]:
    """(differences, report) of two sets of 32-byte ids(id).

    differences: id, side (added: only remote, removed: only local); nulls are no ids. Where a side repeats an id,
    its range isn't solved and meets in the join, which takes repeated ids as one.
    report: range, symbols used, differences found by them (null for ranges that more than `most` symbols didn't
    solve, which are compared by an exact join). Sets may be empty. Ids must be distributed evenly, as digests are.
    """
    spark, work = local.sparkSession, work_dir(local.sparkSession)
    side = lambda x, sign: x.filter("id is not null").select("id", F.lit(sign).alias("sign"))
    side(local, -1).union(side(remote, 1)).write.parquet(f"{work}/both")
    both = spark.read.parquet(f"{work}/both")
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, -(-both.count() // RANGE_IDS)))
    start, stop, wanted, state, finished = 0, first, None, None, None
    while True:
        parts = _folded(both, ranges, start, stop, wanted)
        parts = parts.withColumn("found", F.lit(None).cast("binary")).withColumn("rest", F.lit(None).cast("binary"))
        if state is not None:
            parts = parts.unionByName(state.select("range", F.lit(None).cast("binary").alias("symbols"), "found", "rest"))
        _peeled(parts, start, stop).write.parquet(f"{work}/round{stop}")
        now = spark.read.parquet(f"{work}/round{stop}")
        done, state = now.filter("done"), now.filter("not done")
        finished = done if finished is None else finished.unionByName(done)
        left = sorted((r["range"], r["about"]) for r in state.select("range", "about").collect())  # MOST_RANGES at most
        wanted = [r for r, _ in left]
        if not left or stop >= most:
            break
        typical = sorted(n for _, n in left)[len(left) // 2]
        start, stop = stop, min(most, max(2 * stop, stop + 2 * typical))

    def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, sides = [], []
            for x in f["found"]:
                n = len(x) // 33
                ids += [x[32 * i : 32 * i + 32] for i in range(n)]
                sides += ["added" if s > 0 else "removed" for s in np.frombuffer(x[32 * n :], np.int8)]
            if ids:
                yield pd.DataFrame({"id": ids, "side": sides})

    found = finished.select("found").mapInPandas(unpacked, "id binary, side string")
    if wanted:
        left = both.withColumn("range", _range_of(F.col("id"), ranges)).filter(F.col("range").isin(wanted))
        found = found.unionByName(set_difference(left.filter("sign < 0").select("id"), left.filter("sign > 0").select("id")))
    size = F.floor(F.octet_length("found") / 33).cast("long")
    report = finished.select("range", F.col("n").alias("symbols"), size.alias("differences")).unionByName(state.select("range", F.col("n").alias("symbols"), F.lit(None).cast("long").alias("differences")))
    return found, report


def reconciled_lists(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows (id, side) of two sets of records as lists(pk, ih, t, kws), as records.difference_of_lists() has them.

    Digests of lists are reconciled by symbols, as many as lists differ, and only lists that share key, infohash and time
    with a differing one meet: records of all others are on both sides.
    """
    spark, work = local.sparkSession, work_dir(local.sparkSession)
    words = F.array_join(F.transform(F.array_sort(F.array_distinct("kws")), lambda w: F.concat(F.octet_length(w).cast("string"), F.lit(":"), w)), "")
    digest = F.unhex(F.sha2(F.concat("pk", "ih", le64(F.col("t")), words.cast("binary")), 256))
    for name, side in (("local", local), ("remote", remote)):
        spread(side.dropna(subset=SHARED).filter(F.size("kws") > 0).select(*SHARED, digest.alias("id")).distinct()).write.parquet(f"{work}/{name}")
    a, b = (spark.read.parquet(f"{work}/{name}") for name in ("local", "remote"))
    apart = rateless(a.select("id"), b.select("id"))[0].select("id")
    a.union(b).join(apart, "id", "left_semi").select(*SHARED).distinct().write.parquet(f"{work}/apart")
    meeting = spark.read.parquet(f"{work}/apart")
    return difference_of_lists(local.join(meeting, SHARED, "left_semi"), remote.join(meeting, SHARED, "left_semi"))


def _range_of(id_column, ranges: int):
    """The range of an id, as the folding has it."""

    @F.pandas_udf("long")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(((fnv([bytes(x) for x in ids]) >> np.uint64(20)) % np.uint64(ranges)).astype(np.int64))

    return of(id_column)
