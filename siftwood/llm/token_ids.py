"""Token ids in binary shards, compressed by a Re-Pair grammar that can be decoded from any place."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import WordHashes, arrow_rows, mixed, saved, shared_dir, tidy, trim

#: Ids of a shard, at least, but for the last of a partition.
SHARD_IDS = 1_000_000
#: Rounds of pair replacement that share out the rules, rules in all (symbols stay below 2**16 with a vocabulary of 50,257), least pair count.
ROUNDS, MAX_RULES, LEAST_COUNT = 4, 15_000, 16
#: Every this many symbols the expanded position is stored.
SAMPLE = 1024
#: Pieces whose ids a worker remembers; texts with a longer piece, in bytes, are encoded whole.
MEMORY, LONGEST_PIECE = 1_000_000, 256
#: Bytes of text whose pieces are looked up at once.
GROUP = 1 << 17
#: Shards that a task reads back.
READ_FILES = 6
MAGIC = b"SWRP1\n"

# White space runs in which cutting before a space could split a piece of the tokenizer's pattern.
_RUN = re.compile(r"\s \s|\s \Z")
_TWO = re.compile(r"\s\s")
#: Slots of the table of pieces at first, it doubles when half full; values of the bytes in the two hashes.
SLOTS = 1 << 16
VALUES = np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering those of frequent pieces.

    A byte-level BPE of this pattern never joins what stands before a space, or a line feed, with the
    word behind it, save in longer runs of white space, so the ids of a text are those of its pieces.
    Texts without two white-space characters in a row are cut at both, others at spaces, if none of their
    runs is such, or else encoded whole. A piece that starts with a line feed has no space before it.
    """

    _made: dict = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.powers = WordHashes(GROUP + GROUP // 4)
        self.opens = np.array([x.startswith(("\u0120", "\u010a")) for x in names])  # the byte-level signs of a space and a line feed
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder of this file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        self.flat, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.sizes, self.met = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.uint32)
        self.hash, self.other = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.table, self.slot = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the pieces held, or -1: probing from the hash's own slot on."""
        out = np.full(len(h), -1, np.int64)
        slots = len(self.table)
        at, left = (h & np.uint64(slots - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            here = self.table[at[left]]
            hit = here == h[left]
            out[left[hit]] = self.slot[at[left[hit]]]
            left = left[~hit & (here != 0)]
            at[left] = (at[left] + 1) % slots
        return out

    def _insert(self, h: np.ndarray, place: np.ndarray) -> None:
        """Put distinct new hashes into the first free slots from their own on."""
        slots = len(self.table)
        at = (h & np.uint64(slots - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.table[at[left]] == 0]
            self.table[at[free]], self.slot[at[free]] = h[free], place[free]
            left = left[self.table[at[left]] != h[left]]
            at[left] = (at[left] + 1) % slots

    def _hold(self, h: np.ndarray, other: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Add pieces, by two hashes, with their ids, behind those that are held; starts count from there."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held + len(sizes) > len(self.starts):
            self.starts, self.sizes, self.met, self.hash, self.other = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.met, self.hash, self.other))
        new = slice(self.held, self.held + len(sizes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[new], self.sizes[new], self.hash[new], self.other[new] = self.used + starts, sizes, h, other
        self.used, self.held = self.used + len(flat), new.stop
        if 2 * self.held > len(self.table):
            slots = 1 << (2 * self.held).bit_length()
            self.table, self.slot = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self._insert(self.hash[: self.held], np.arange(self.held))
        else:
            self._insert(h, np.arange(new.start, new.stop))

    def _forget(self) -> None:
        """Keep the pieces that were met again, at most half of MEMORY: those met most."""
        met = self.met[: self.held]
        order = np.argsort(met, kind="stable")[::-1][: MEMORY // 2]
        keep = np.sort(order[met[order] > 1])
        sizes, h, other, again = self.sizes[keep], self.hash[keep], self.other[keep], met[keep] // 2
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.starts[keep] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        self._clear()
        self._hold(h, other, flat, ends - sizes, sizes)
        self.met[: self.held] = again

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[np.ndarray]:
        """Ids of all pieces one after another, and how many each has: those without white space inside many at a time."""
        ids, sizes = [], []
        for i in range(0, len(words), 64):
            part = words[i : i + 64]
            whole = [w if w[:1] == "\n" else " " + w for w in part]
            text = "".join(whole)
            plain = len(text.split()) == len(part) and "" not in part
            x = self._plain([text])[0] if plain else np.zeros(0, np.uint32)
            n = np.diff(np.append(np.flatnonzero(self.opens[x]), len(x)))
            if len(n) != len(part):
                each = self._plain(whole)
                x, n = np.concatenate(each), np.array([len(y) for y in each])
            ids.append(x)
            sizes.append(n)
        return [np.concatenate(ids), np.concatenate(sizes).astype(np.int64)]

    def _hashes(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the pieces of a run of bytes: polynomials with other values for the bytes."""
        self.powers.grow(len(b) + 1)
        out, total = [], np.zeros(len(b) + 1, np.uint64)
        for values in VALUES:
            np.cumsum(values[b] * self.powers.power[: len(b)], out=total[1:])
            out.append(mixed((total[ends] - total[starts]) * self.powers.inverse[starts] + (ends - starts).astype(np.uint64)))
        return np.maximum(out[0], np.uint64(1)), out[1]  # 0 marks a free slot

    def _group(self, parts: list[tuple[bytes, bool]]) -> list[np.ndarray | None]:
        """Ids of parts of texts, pieces apart by one space each; the flag says that a part starts its text. None where a piece is too long."""
        data = b" ".join([x for x, _ in parts])
        b = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(b == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
        size = np.array([len(x) + 1 for x, _ in parts])
        first = np.searchsorted(starts, np.cumsum(size) - size)
        part = np.repeat(np.arange(len(parts)), np.diff(np.append(first, len(starts))))
        bad = np.maximum.reduceat(ends - starts, first) > LONGEST_PIECE
        opening = np.array([x for _, x in parts])
        use = ~bad[part]
        use[first[opening]] = False  # a text's first piece has no space before it
        where = np.flatnonzero(use)
        h, other = (x[where] for x in self._hashes(b, starts, ends))
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, one, which = np.unique(h[miss], return_index=True, return_inverse=True)
            places = where[miss[one]]
            words = [data[i:j].decode() for i, j in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]
            flat, sizes = self._pieces(words)
            at[miss] = self.held + which
            self._hold(new, other[miss[one]], flat, np.cumsum(sizes) - sizes, sizes)
        bad[part[where[self.other[at] != other]]] = True  # another piece of that hash
        sizes = self.sizes[at]
        ends_at = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - ends_at + sizes, sizes) + np.arange(int(sizes.sum()))]
        cuts = np.concatenate([[0], ends_at])[np.concatenate([[0], np.cumsum(np.bincount(part[where], minlength=len(parts)))])]
        heads = iter(self._plain([data[i:j].decode() for i, j in zip(starts[first[opening]].tolist(), ends[first[opening]].tolist(), strict=True)]))
        out: list[np.ndarray | None] = []
        for k, opens in enumerate(opening):
            x = ids[cuts[k] : cuts[k + 1]]
            out.append(np.concatenate([next(heads), x]) if opens else x)
        self.met[: self.held] += np.bincount(at, minlength=self.held).astype(np.uint32)
        if self.held > MEMORY:
            self._forget()
        return [None if b else x for b, x in zip(bad, out, strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        found: dict[int, list] = {}
        group, size = [], 0

        def flush() -> None:
            nonlocal group, size
            for (i, *_), x in zip(group, self._group([(raw, opens) for _, raw, opens in group]), strict=True):
                found[i].append(x)
            group, size = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if not _TWO.search(t) and not t[-1].isspace() and t[0] != "\n":
                raw = t.replace("\n", " \n").encode()
            elif " \n" not in t and not _RUN.search(t):
                raw = t.encode()
            else:
                continue
            found[i], at = [], 0
            while at <= len(raw):  # long texts in parts that end before a space
                end = raw.find(b" ", at + GROUP) if at + GROUP < len(raw) else len(raw)
                end = len(raw) if end < 0 else end
                group.append((i, raw[at:end], at == 0))
                size, at = size + end - at, end + 1
                if size >= GROUP:
                    flush()
        if group:
            flush()
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and (i not in found or any(x is None for x in found[i]))]
        for i, ids in zip(whole, self._plain([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for i, parts in found.items():
            if all(x is not None for x in parts):
                out[i] = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return out


def re_pair(ids: np.ndarray, first: int, rounds: int = ROUNDS, max_rules: int = MAX_RULES, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): ids below `first` with frequent neighbouring pairs replaced by nonterminals first, first + 1, ...

    Each round counts pairs, gives the most frequent ones a rule each and replaces them from
    left to right; rules may hold nonterminals of earlier rounds. The first rounds share out the rules;
    more follow until no pair is left that occurs `least` times, or no rule. Once a round has replaced
    all frequent pairs, only pairs with a symbol of the round before can have become frequent, and
    just these are counted. rules[k] is the pair of symbol first + k. Pairs are counted in buckets first, about one for each id;
    where the pairs of the fullest buckets turn out to be rare, those of all buckets that can hold a frequent pair are counted.
    """
    wide, bits = first + max_rules > 1 << 16, min(26, max(20, len(ids).bit_length()))
    kind, shift, spread, down = (np.uint64, 32, 0x9E3779B97F4A7C15, 64 - bits) if wide else (np.uint32, 16, 0x9E3779B1, 32 - bits)
    home = lambda keys: ((keys * kind(spread)) >> kind(down)).astype(np.int64)
    s, rules, fresh, all_buckets = ids.astype(kind), [], None, False
    for r in count_from(0):
        room = (max_rules - len(rules)) // max(1, rounds - r)
        if len(s) < 2 or room <= 0:
            break
        if fresh is None:
            key = (s[:-1] << kind(shift)) | s[1:]
            bucket = home(key)
            count = np.bincount(bucket, minlength=1 << bits)
            above = np.cumsum(np.bincount(np.minimum(count, 1 << 12))[::-1])[::-1]  # buckets of at least so many pairs
            cut = least if all_buckets else max(least, int(np.flatnonzero(above >= 2 * room).max(initial=0)))  # pairs of rarer buckets are rarer still
            at = np.flatnonzero((count >= cut)[bucket])
            bucket = count = above = None
            key = key[at]
        else:
            new = s >= fresh
            at = np.flatnonzero(new[:-1] | new[1:])
            key, cut = (s[at] << kind(shift)) | s[at + 1], least
        sort = np.sort(key)
        where = np.flatnonzero(np.concatenate([[True], sort[1:] != sort[:-1]])) if len(sort) else np.zeros(0, np.int64)
        pairs, times, sort = sort[where], np.diff(np.append(where, len(sort))), None
        order = np.lexsort((pairs, -times))
        best = frequent = pairs[order[times[order] >= least]]
        if fresh is None:
            best = best[np.sort(np.unique(home(best), return_index=True)[1])]  # the most frequent pair of a bucket
        whole = cut == least and len(best) == len(frequent) and len(best) <= room
        best = best[:room]
        if not len(best):
            if whole:
                break
            fresh, all_buckets = None, True
            continue
        symbols = first + len(rules) + np.arange(len(best), dtype=kind)
        if fresh is None:
            owner, symbol = np.zeros(1 << bits, kind), np.zeros(1 << bits, kind)
            owner[home(best)], symbol[home(best)] = best, symbols
            bucket = home(key)
            hit = (owner[bucket] == key) & (symbol[bucket] > 0)
            at, given = at[hit], symbol[bucket[hit]]
        else:
            by_key = np.argsort(best)
            place = np.minimum(np.searchsorted(best[by_key], key), len(best) - 1)
            hit = best[by_key][place] == key
            at, given = at[hit], symbols[by_key][place[hit]]
        start = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of runs of overlapping pairs
        odd = (np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2
        at, given = at[odd == 0], given[odd == 0]
        s[at] = given
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        fresh = kind(first + len(rules)) if whole else None
        rules += [(int(p) >> shift, int(p) & ((1 << shift) - 1)) for p in best]
    return s.astype(np.int64), np.array(rules, np.int64).reshape(-1, 2)


def rule_sizes(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    sizes = [1] * first
    for a, b in rules.tolist():
        sizes.append(sizes[a] + sizes[b])
    return np.array(sizes, np.int64)


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, starts, sizes) of all symbols' ids: a terminal is itself."""
    sizes = np.ones(first + len(rules), np.int64)
    whole: list = []
    for k, (a, b) in enumerate(rules.tolist()):
        x = (whole[a - first] if a >= first else (a,)) + (whole[b - first] if b >= first else (b,))
        whole.append(x)
        sizes[first + k] = len(x)
    flat = np.concatenate([np.arange(first), *map(np.array, whole)]).astype(np.uint32)
    return flat, np.cumsum(sizes) - sizes, sizes


def decoded(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, starts, sizes = table
    n = sizes[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[symbols] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


NO_ID = -(1 << 63)


def shard_bytes(doc_ids: list[int | None], docs: list[np.ndarray], first: int, max_rules: int = MAX_RULES, least: int = LEAST_COUNT) -> bytes:
    """A shard file: magic, header length, JSON header, then the arrays that the header names."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    symbols, rules = re_pair(ids, first, max_rules=max_rules, least=least)
    each = rule_sizes(rules, first)
    ends = np.cumsum(each[symbols])
    width = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    arrays = {
        "doc_ids": np.array([NO_ID if x is None else x for x in doc_ids], "<i8"),
        "doc_sizes": np.array([len(x) for x in docs], "<u4"),
        "rules": rules.astype("<u4"),
        "rule_sizes": each[first:].astype("<u4"),
        "samples": (np.concatenate([[0], ends])[:-1:SAMPLE] if len(symbols) else np.zeros(0)).astype("<i8"),
        "symbols": symbols.astype(width),
    }
    body = b"".join(a.tobytes() for a in arrays.values())
    header = {"first": first, "n_ids": len(ids), "crc32": zlib.crc32(body), "arrays": {k: [a.dtype.str, a.size] for k, a in arrays.items()}}
    head = json.dumps(header).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + body


def _layout(header: dict, base: int) -> dict[str, tuple[str, int, int]]:
    out = {}
    for k, (kind, n) in header["arrays"].items():
        out[k] = (kind, base, n)
        base += np.dtype(kind).itemsize * n
    return out


def shard_arrays(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and arrays of a whole shard file; raises ValueError if it is damaged."""
    size = int.from_bytes(data[len(MAGIC) : len(MAGIC) + 4], "little")
    base = len(MAGIC) + 4 + size
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    header = json.loads(data[len(MAGIC) + 4 : base])
    if zlib.crc32(memoryview(data)[base:]) != header["crc32"]:
        raise ValueError("damaged token shard")
    return header, {k: np.frombuffer(data, kind, n, at) for k, (kind, at, n) in _layout(header, base).items()}


def read_ids(uri: str, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a shard, reading only its rules, samples and the symbols that cover them."""
    size = int.from_bytes(files.read_range(uri, len(MAGIC), 4), "little")
    header = json.loads(files.read_range(uri, len(MAGIC) + 4, size))
    where = _layout(header, len(MAGIC) + 4 + size)

    def part(name: str, a: int = 0, b: int | None = None) -> np.ndarray:
        kind, at, n = where[name]
        b = n if b is None else min(b, n)
        step = np.dtype(kind).itemsize
        return np.frombuffer(files.read_range(uri, at + a * step, (b - a) * step), kind)

    start, stop = max(0, start), min(stop, header["n_ids"])
    if start >= stop:
        return np.zeros(0, np.uint32)
    samples = part("samples")
    a = int(np.searchsorted(samples, start, "right")) - 1
    b = int(np.searchsorted(samples, stop, "left"))
    table = expansions(part("rules").reshape(-1, 2).astype(np.int64), header["first"])
    ids = decoded(part("symbols", a * SAMPLE, b * SAMPLE).astype(np.int64), table)
    return ids[start - int(samples[a]) : stop - int(samples[a])]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS, max_rules: int = MAX_RULES, least: int = LEAST_COUNT) -> DataFrame:
    """Encode whole texts and write shards in ascending doc_id order; returns the manifest of committed files.

    docs: doc_id, text; other columns are ignored. Rows that share a doc_id are ordered by text;
    null ids come first; null texts are empty. Manifest: part, seq (their order is that of the ids),
    path, n_docs, n_ids. Files have fixed names and appear by a rename, and the manifest, itself a
    committed Parquet table, names every valid one, so repeated tasks do no harm. An empty table
    writes nothing.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 256)
    path = tokenizer or default_tokenizer()
    files.make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path)
        first = encode.tokenizer.get_vocab_size(with_added_tokens=True)
        part, seq, ids, docs, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            uri = f"{folder}/shard-{part:06d}-{seq:06d}.ids"
            trim()  # what encoding left, before the shard's own arrays
            files.commit(uri, shard_bytes(ids, docs, first, max_rules, least))
            trim()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": uri, "n_docs": len(docs), "n_ids": size}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            found = encode([t or "" for t in b.column("text").to_pylist()])
            for doc_id, x in zip(b.column("doc_id").to_pylist(), found, strict=True):
                ids.append(doc_id)
                docs.append(np.append(x, np.uint32(end_id)))
                size += len(x) + 1
                if size >= shard_ids:
                    yield flush()
                    seq, ids, docs, size = seq + 1, [], [], 0
        if ids:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return saved(rows.mapInArrow(tidy(run), "part int, seq int, path string, n_docs long, n_ids long"), f"{folder}/_manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before), n_tokens, ids_crc32, path, shard_start (in its file)."""
    spark = manifest.sparkSession
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition
    total, before = 0, {}
    for r in sums:
        before[r.part], total = total, total + r.n
    offsets = spark.sparkContext.broadcast(before)
    running = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(running), F.lit(0))).repartition(files.readers(-(-manifest.count() // READ_FILES)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                header, a = shard_arrays(files.read(row["path"]))
                ids = decoded(a["symbols"].astype(np.int64), expansions(a["rules"].reshape(-1, 2).astype(np.int64), header["first"])).astype("<u4")
                ends = np.cumsum(a["doc_sizes"].astype(np.int64))
                starts = ends - a["doc_sizes"]
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc = pa.array(a["doc_ids"], mask=a["doc_ids"] == NO_ID)
                base = offsets.value[row["part"]] + row["base"]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([doc, pa.array(starts + base), pa.array(a["doc_sizes"].astype(np.int64)), pa.array(crc, pa.int64()), pa.array([row["path"]] * n), pa.array(starts)], names=["doc_id", "start", "n_tokens", "ids_crc32", "path", "shard_start"])

    return shards.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long, path string, shard_start long")


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS, max_rules: int = MAX_RULES, least: int = LEAST_COUNT) -> DataFrame:
    """Write the shards of docs into a fresh shared folder and return what is read back.

    Larger shards, more rules and rarer pairs shorten the files and cost time; the ids read back are the same.
    """
    return read_shards(write_shards(docs, shared_dir(docs.sparkSession) + "/ids", tokenizer, end_id, shard_ids, max_rules, least))
