"""Exact Jaccard join on word shingles: token-combination prefixes, then verification.

Tokens are 64-bit hashes of shingles. Their global order puts rare tokens first (by hash) and
frequent ones last (by document frequency). A document's prefix is the shortest run of its ordered
tokens that a partner at the threshold cannot miss: rare tokens are indexed alone; frequent tokens
fall into classes by hash and are indexed as pairs of one class, each class costing the prefix one
more token. What is frequent only steers the order, so it may come from bounded fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, connected, dealt_join, mixed, packed, packed_sorted, released, removed, saved, shared_dir, tidy, unpacked, unpacked_sorted

#: A token in more documents than this counts as frequent.
FREQUENT = 32
#: The most frequent fingerprints that are held as frequent (4 bytes each, broadcast).
MOST_FREQUENT = 1 << 20
#: Ranges of fingerprints that are counted apart, each with a counter for every fingerprint of it (8 MB).
RANGES = 4096
#: Shingles gathered before their fingerprints are sent to the ranges.
FLUSH = 6_000_000
#: Members that are verified against one copy of their leader.
BLOCK = 256
#: Rows of a bucket that meet in one piece of a task.
MEETING = 512
#: Bins of the sketches, and first signatures, that such a row carries; bins of two bits that stand for sketches of up to CAPPED bins.
FOLDED, FIRSTS = 128, 8
NARROW, CAPPED, CAP = 512, 1024, 3
#: Bits a document, and the least and most bits, of the filter for documents that verification needs.
FILTER_SHARE, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


class Shingler:
    """Sets of hashed shingles of whole texts."""

    def __init__(self, size: int):
        self.size, self.hashes = size, WordHashes()

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        return [self._set(h) for h in self.hashes.texts(texts)]

    def _set(self, h: np.ndarray) -> np.ndarray:
        """Distinct runs of `size` word hashes, ascending; a shorter text is one run."""
        n, k = len(h), min(self.size, len(h))
        if not n:
            return h
        out = h[: n - k + 1] + np.uint64(k)
        for j in range(1, k):
            out = out * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
            out += h[j : n - k + 1 + j]
        out = mixed(out)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of tokens in hashed bins, a power of two of them from the set's size on; empty if a byte can't hold one."""
    bins = min(1 << 15, 1 << max(4, (len(tokens) - 1).bit_length()))
    count = np.bincount((tokens & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return count.astype(np.uint8).tobytes() if len(tokens) and count.max() < 256 else b""


def folded(x: bytes, bins: int) -> bytes:
    """A sketch of at most so many bins; empty if a byte can't hold one."""
    if len(x) <= bins:
        return x
    count = np.frombuffer(x, np.uint8).reshape(-1, bins).sum(0, dtype=np.int64)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def carried(x: bytes) -> bytes:
    """A sketch in at most 2 + NARROW / 4 bytes: middle ones as counts of two bits, four a byte, behind the sum of what is above CAP; long ones folded."""
    if not FOLDED < len(x) <= CAPPED:
        return folded(x, FOLDED)
    count = np.frombuffer(x, np.uint8).reshape(-1, min(len(x), NARROW)).sum(0, dtype=np.int64)
    low = np.minimum(count, CAP)
    return int((count - low).sum()).to_bytes(2, "little") + (low.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8).tobytes()


class Carried:
    """Carried sketches of several sets, for upper bounds of intersections."""

    def __init__(self, rows: list[bytes]):
        self.over, plain = np.zeros(len(rows), np.int64), []
        for i, x in enumerate(rows):
            if len(x) % 4 == 2:  # plain ones have a power of two of bins, 16 at least
                self.over[i] = int.from_bytes(x[:2], "little")
                x = ((np.frombuffer(x, np.uint8, offset=2)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & CAP).astype(np.uint8).tobytes()
            plain.append(x)
        self.sketches = Sketches(plain)

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The most tokens that sets x and y can share. What is above CAP only meets its like in equal bins; else it may meet anything."""
        a, b, bins = self.over[x], self.over[y], self.sketches.bins
        same = (bins[x] == bins[y]) & (bins[x] > FOLDED)
        return self.sketches.bound(x, y) + np.where(same, np.minimum(a, b), a + b)


class Sketches:
    """Sketches of several sets, for upper bounds of intersections."""

    def __init__(self, sketches: list[bytes]):
        self.bins = np.array([len(x) for x in sketches], np.int64)
        self.place, self.rows = np.zeros(len(sketches), np.int64), {}
        for b in np.unique(self.bins):
            at = np.flatnonzero(self.bins == b)
            self.place[at] = np.arange(len(at))
            self.rows[int(b)] = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8).reshape(len(at), -1) if b else None

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The most tokens that sets x and y can share; the largest number where a sketch is missing."""
        out = np.full(len(x), np.iinfo(np.int64).max // 1000)
        kind = self.bins[x] * (1 << 20) + self.bins[y]
        for k in np.unique(kind):
            p, q = int(k) >> 20, int(k) & ((1 << 20) - 1)
            if not p or not q:
                continue
            at, low = np.flatnonzero(kind == k), min(p, q)
            for i in range(0, len(at), step := max(1, (1 << 22) // max(p, q))):
                part = at[i : i + step]
                a, b = self.rows[p][self.place[x[part]]], self.rows[q][self.place[y[part]]]
                a, b = (v if v.shape[1] == low else v.reshape(len(v), -1, low).sum(1, dtype=np.uint16) for v in (a, b))
                out[part] = np.minimum(a, b).sum(1, dtype=np.int64)
        return out


def _ceil(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


class Signatures:
    """Prefix signatures of token sets for a Jaccard threshold num/den."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        """frequent: fingerprints (upper 32 bits), from less to more frequent."""
        self.num, self.den = num, den
        self.rank = np.argsort(frequent, kind="stable")
        self.fingerprints = frequent[self.rank]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        need = n - _ceil(n, self.num, self.den) + 1
        if n == 0:
            return tokens
        if len(self.fingerprints):
            fp = (tokens >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.fingerprints, fp), len(self.fingerprints) - 1)
            common = self.fingerprints[at] == fp
            rare = tokens[~common]
        else:
            rare = tokens
        if len(rare) >= need or n == 1:
            return tokens[:1] if n == 1 else rare[:need]
        hot = tokens[common]
        hot = hot[np.lexsort((hot, self.rank[at[common]]))]
        out = [rare]
        least = _ceil(n, self.num, self.den)
        for s in range(least.bit_length(), n.bit_length() + 1):  # size classes that a partner's smaller set can have
            classes = max(1, (1 << s) * (self.den - self.num) // (6 * self.den))
            group = (mixed(hot ^ np.uint64(s)) % np.uint64(classes)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            first = np.ones(len(hot), bool)
            first[order[1:]] = group[order[1:]] != group[order[:-1]]
            gained = np.cumsum(~first)  # a class of c tokens withstands c - 1 losses
            stop = int(np.searchsorted(gained, need - len(rare))) + 1
            used, group = hot[:stop], group[:stop]
            order = np.argsort(group, kind="stable")
            used, group = used[order], group[order]
            gap = 1
            while gap < len(used):
                same = group[gap:] == group[:-gap]
                if not same.any():
                    break
                a, b = used[:-gap][same], used[gap:][same]
                out.append(mixed(np.minimum(a, b) * np.uint64(3) + mixed(np.maximum(a, b)) + np.uint64(s)))
                gap += 1
        return np.unique(np.concatenate(out))


def _digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _counts(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs (or the sum of its weights)."""
    order = None if weights is None else np.argsort(values, kind="stable")
    values = np.sort(values) if order is None else values[order]
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    total = np.diff(np.append(at, len(values))) if order is None else np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)
    return values[at], total


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest and sketch of every set (range null), and fingerprints for counting (range, payload)."""
    names = ["doc_id", "n", "digest", "sketch", "range", "payload"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, count = Shingler(size), [], 0

        def flush():
            fp, times = _counts(np.concatenate(held))
            cuts = np.searchsorted(fp, (np.arange(1, RANGES, dtype=np.uint64) << np.uint64(32)) // np.uint64(RANGES))
            rows = []
            for r, (f, t) in enumerate(zip(np.split(fp, cuts), np.split(times, cuts), strict=True)):
                if len(f):
                    a, b = packed_sorted(f), packed(t.astype(np.uint32))
                    rows.append((r, len(a).to_bytes(4, "little") + a + b))
            none = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([none, none, none, none, [r for r, _ in rows], [x for _, x in rows]], kinds, strict=True)], names=names)

        for b in batches:
            sets = shingle(_bytes(b.column("text")))
            n = [len(x) for x in sets]
            columns = [b.column("doc_id"), pa.array(n, pa.int32()), pa.array([_digest(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            held += [(x >> np.uint64(32)).astype(np.uint32) for x in sets]
            count += sum(n)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n int, digest long, sketch binary, range int, payload binary")


def frequent_tokens(rows: DataFrame, least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Fingerprints in more than `least` sets, from less to more frequent; at most `most` of them, the most frequent.

    A range adds its payloads one by one to its counters, so its memory is the same at any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros((1 << 32) // RANGES, np.int64)

        def found() -> pa.RecordBatch:
            at = np.flatnonzero(total > least)
            return pa.RecordBatch.from_arrays([pa.array(at + now * len(total)), pa.array(total[at])], names=["fp", "df"])

        for b in batches:
            for r, x in zip(b.column("range").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if r != now:
                    if now is not None:
                        yield found()
                        total[:] = 0
                    now = r
                size = int.from_bytes(x[:4], "little")
                total[unpacked_sorted(x[4 : 4 + size], np.uint32) - np.uint32(now * len(total))] += unpacked(x[4 + size :], np.uint32)
        if now is not None:
            yield found()

    payloads = rows.filter("range is not null").select("range", "payload").repartition("range").sortWithinPartitions("range")
    counted = payloads.mapInArrow(tidy(run), "fp long, df long")
    top = counted.orderBy(F.desc("df"), "fp").limit(most).toPandas()  # bounded by `most`
    return top["fp"].to_numpy(np.uint32)[::-1].copy()


def postings(docs: DataFrame, size: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """Rows (sig, digest, n, doc_id): the prefix signatures of every set, once a task for each distinct set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT * 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign, met = Shingler(size), Signatures(num, den, shared.value), set()
        for b in batches:
            rows = []
            for i, x in zip(b.column("doc_id").to_pylist(), shingle(_bytes(b.column("text"))), strict=True):
                if i is not None and len(x) and (k := (_digest(x), len(x))) not in met:
                    met.add(k)
                    rows.append((i, *k, sign(x)))
            if rows:
                width = [len(s) for *_, s in rows]
                columns = [np.concatenate([s for *_, s in rows]).view(np.int64), np.repeat([d for _, d, *_ in rows], width), np.repeat(np.array([n for _, _, n, _ in rows], np.int32), width), np.repeat([i for i, *_ in rows], width)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["sig", "digest", "n", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "sig long, digest long, n int, doc_id long")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit filter over doc ids, packed; its bits follow their number, up to MOST_BITS (32 MB)."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, FILTER_SHARE * ids.count() - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = np.unique(mixed(b.column(0).to_numpy().view(np.uint64)) % np.uint64(bits)).astype(np.int64)
            word, start = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    words = ids.mapInArrow(tidy(run), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["value"].to_numpy(np.int64)
    return out.view(np.uint8)


def _sets(docs: DataFrame, size: int, bits: np.ndarray) -> DataFrame:
    """doc_id and token set of the documents that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(bits))

    def run(batches):
        shingle, known = Shingler(size), unpacked(shared.value, np.uint8)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            valid = np.asarray(b.column("doc_id").is_valid())
            key = np.where(valid, ids, 0).astype(np.int64)
            at = mixed(key.view(np.uint64)) % np.uint64(8 * len(known))
            hit = valid & (((known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) > 0)
            take = np.flatnonzero(hit)
            texts = b.column("text").cast(pa.binary())
            for i in range(0, len(take), 64):
                part = take[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array([x.tobytes() for x in shingle(texts.take(pa.array(part)).to_pylist())], pa.binary())], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, tokens binary")


def promising(pairs: DataFrame, base: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for the threshold; no pair that reaches it is lost. Pairs of a frequent a are dealt to tasks."""
    side = lambda c: base.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")).filter(F.col(c).isNotNull()).dropDuplicates([c])
    sizes = pairs.groupBy("a").agg(F.count("*").alias("pairs"))
    rows = dealt_join(pairs, side("a").join(sizes, "a"), ["a"], "pairs", pairs.count()).join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb, n = x.column("na").to_numpy().astype(np.int64), x.column("nb").to_numpy().astype(np.int64), len(x)
            most = Sketches(x.column("sa").to_pylist() + x.column("sb").to_pylist()).bound(np.arange(n), np.arange(n, 2 * n))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(den * most >= num * (na + nb - most)))

    return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def crossing(open_rows: DataFrame, base: DataFrame, num: int, den: int, work: str) -> DataFrame:
    """Distinct pairs (a, b) of one bucket that lie in different parts and that sizes and sketches leave room for.

    open_rows: sig, id, n, part. Buckets are cut into blocks that meet pairwise, and a task compares
    short sketches of the blocks that it holds, so only pairs that may be links leave it. A row
    carries its document's first signatures: a pair that shares an earlier one of them is left to
    that bucket, so few pairs leave twice.
    """
    sketches = base.select(F.col("doc_id").alias("id"), "sketch").filter("id is not null").dropDuplicates(["id"])
    facts = open_rows.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRSTS).alias("firsts")).join(sketches, "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("firsts"), pa.array([carried(v) for v in x.column("sketch").to_pylist()], pa.binary())], names=["id", "firsts", "sketch"])

    facts = saved(facts.select("id", "firsts", "sketch").mapInArrow(fold, "id long, firsts array<long>, sketch binary"), work)
    rows = open_rows.withColumn("blocks", F.ceil(F.expr("count(*) over (partition by sig)") / MEETING).cast("int")).join(facts, "id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "sig"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    keys = ["sig", "left", "right"]
    rows = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).select(*keys, "block", "id", "n", "part", "firsts", "sketch")

    def meet(t: pa.Table) -> pa.RecordBatch:
        key = [t.column(k).to_numpy() for k in keys]
        block, ids, n, part = (t.column(k).to_numpy().astype(np.int64) for k in ("block", "id", "n", "part"))
        group = np.cumsum(np.concatenate([[False], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
        apart, known, out = key[1] != key[2], Carried(t.column("sketch").to_pylist()), []
        firsts = np.full((len(t), FIRSTS), np.iinfo(np.int64).max)
        for i, x in enumerate(t.column("firsts").to_pylist()):
            firsts[i, : len(x)] = x
        firsts[firsts >= key[0][:, None]] = np.iinfo(np.int64).max  # only earlier ones
        for gap in range(1, int(np.bincount(group).max(initial=0))):
            x = np.flatnonzero(group[gap:] == group[:-gap])
            y = x + gap
            keep = (part[x] != part[y]) & (~apart[x] | (block[x] != block[y])) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
            x, y = x[keep], y[keep]
            most = known.bound(x, y)
            keep = den * most >= num * (n[x] + n[y] - most)
            x, y = x[keep], y[keep]
            shared = (firsts[x][:, :, None] == firsts[y][:, None, :]) & (firsts[x] != np.iinfo(np.int64).max)[:, :, None]
            keep = ~shared.any((1, 2))
            out.append(np.stack([np.minimum(ids[x[keep]], ids[y[keep]]), np.maximum(ids[x[keep]], ids[y[keep]])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < 8 * MEETING:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(len(t), bool)
            for k in keys:
                v = t.column(k).to_numpy()
                last &= v == v[-1]
            cut = int(np.argmax(last))  # the last group may go on
            if cut:
                yield meet(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield meet(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int, work: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Blocks of members meet one copy of their leader a."""
    members = pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("salt"), F.lit(1).alias("member"))
    sizes = pairs.groupBy(F.col("a").alias("leader")).agg(F.count("*").alias("pairs")).withColumn("blocks", F.ceil(F.col("pairs") / BLOCK).cast("long"))
    members = dealt_join(members, sizes, ["leader"], "pairs", pairs.count()).select("doc_id", "leader", F.pmod("salt", "blocks").alias("block"), "member")
    members = saved(members, f"{work}/members")
    leaders = members.select("leader", "block").distinct().select(F.col("leader").alias("doc_id"), "leader", "block", F.lit(0).alias("member"))
    needs = members.unionByName(leaders)
    bits = _filter_of(members.select("doc_id").union(members.select("leader")))
    rows = needs.join(_sets(docs, size, bits).dropDuplicates(["doc_id"]), "doc_id")

    def check(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        member, tokens, ids = table.column("member").to_numpy(), table.column("tokens"), table.column("doc_id").to_numpy()
        lead = np.flatnonzero(member == 0)
        if not len(lead):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x = np.frombuffer(tokens[int(lead[0])].as_py(), np.uint64)
        out = []
        for j in np.flatnonzero(member == 1):
            y = np.frombuffer(tokens[int(j)].as_py(), np.uint64)
            at = np.searchsorted(x, y)
            both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
            if both and den * both >= num * (len(x) + len(y) - both):
                out.append(ids[j])
        return pa.table({"a": np.full(len(out), ids[lead[0]], np.int64), "b": np.array(out, np.int64)})

    return rows.groupBy("leader", "block").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of num/den or more.

    Returns one row per row of docs(doc_id, text): doc_id, n_shingles (distinct shingles of `size`
    words; a shorter text is one shingle), component_id (the smallest doc_id reachable by links,
    itself included). Null and empty texts and texts without words have no shingles and link with
    nothing, not even each other. Repeated rows (one doc_id, equal text) fall together; doc_id
    must otherwise be unique. Rows of a null doc_id link with nothing but equal sets, and have a null
    component where no other row is in it. Other columns are ignored.

    Equal sets meet by digest. Distinct sets that share a prefix signature are first compared with
    the bucket's smallest id; after components are drawn from those links, only pairs of one bucket
    that still lie in different components and can reach the threshold by size are compared.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    work = shared_dir(spark)
    rows = saved(profiles(docs, size), f"{work}/profiles")
    released(spark)
    base = rows.filter("range is null").select("doc_id", "n", "digest", "sketch")
    frequent = frequent_tokens(rows)
    fits = lambda a, b: (F.least(a, b) * den >= F.greatest(a, b) * num)

    posts = postings(docs, size, num, den, frequent).repartition(F.col("sig"))
    posts = posts.groupBy("sig", "digest", "n").agg(F.min("doc_id").alias("id"))
    leader = F.expr("min(struct(id, n)) over (partition by sig)")
    posts = posts.withColumn("lead", leader).withColumn("size", F.expr("count(*) over (partition by sig)")).filter("size > 1")
    posts = saved(posts.select("sig", "id", "n", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")), f"{work}/posts")
    released(spark)

    stars = posts.filter(F.col("id") != F.col("lead")).filter(fits(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    stars = saved(stars, f"{work}/stars")
    hopeful = saved(promising(stars, base, num, den), f"{work}/hopeful1")
    links = saved(verified(hopeful, docs, size, num, den, f"{work}/v1"), f"{work}/links1")
    released(spark)
    parts = saved(connected(links, f"{work}/c1"), f"{work}/parts1")

    open_rows = posts.select("sig", "id", "n").join(parts, F.col("id") == F.col("node"), "left").select("sig", "id", "n", F.coalesce("component", "id").alias("part"))
    spread = "over (partition by sig)"
    open_rows = saved(open_rows.withColumn("lo", F.expr(f"min(part) {spread}")).withColumn("hi", F.expr(f"max(part) {spread}")).filter("lo <> hi").select("sig", "id", "n", "part"), f"{work}/open")
    rest = saved(crossing(open_rows, base, num, den, f"{work}/facts").join(stars, ["a", "b"], "left_anti"), f"{work}/met")
    rest = saved(promising(rest, base, num, den), f"{work}/rest")
    for old in ("posts", "open", "facts", "hopeful1"):
        removed(spark, f"{work}/{old}")
    released(spark)
    if not rest.isEmpty():
        more = saved(verified(rest, docs, size, num, den, f"{work}/v2"), f"{work}/links2")
        parts = saved(connected(links.union(more), f"{work}/c2"), f"{work}/parts2")

    sets = base.filter("n > 0")
    classes = sets.groupBy("digest", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    linked = base.join(parts, F.col("doc_id") == F.col("node")).select("digest", "n", "component").distinct()
    classes = saved(classes.join(linked, ["digest", "n"], "left"), f"{work}/classes")
    total, many = base.count(), classes.filter("component is not null")
    least = many.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("sets"))
    named = dealt_join(many, least, ["component"], "sets", many.count()).select("digest", "n", "component_id", "rows")
    classes = saved(named.unionByName(classes.filter("component is null").select("digest", "n", F.col("first").alias("component_id"), "rows")), f"{work}/named")
    full = dealt_join(sets.select("doc_id", "digest", "n"), classes, ["digest", "n"], "rows", total).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = base.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none)
