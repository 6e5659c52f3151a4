"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a bounded run of whole documents. Its text is a sequence of word ids over the words of
the benchmark; every other word is one id that no window contains, and runs of benchmark words
shorter than the shortest window are dropped, since no window fits there. The index is the
wavelet tree of the Burrows-Wheeler transform with sampled suffix positions. All windows are
searched backwards at once; occurrences are located through the samples and merged to spans.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .common import arrow_rows, shared_dir, tidy

#: Words of a window; items of fewer words are one window.
WINDOW = 10
#: Words of a shard's index, and documents in it.
SHARD_WORDS, SHARD_DOCS = 500_000, 20_000
#: Every this many suffix positions are sampled.
SAMPLE = 16
#: Bytes of text that a shard holds.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 4 << 20

_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_TABLE).split() if text else []


def _nulls_last(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


class Patterns:
    """The windows of benchmark items as word-id sequences, deduplicated, with their items, in arrays."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        rows, own, sizes, self.items = [], [], [], sorted({i for i, _ in items}, key=_nulls_last)
        place = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)], np.int32)
            if len(w):
                n, k = max(1, len(w) - window + 1), min(window, len(w))
                run = np.zeros((n, window), np.int32)
                run[:, :k] = np.lib.stride_tricks.sliding_window_view(w, k)
                rows.append(run)
                own.append(np.full(n, place[item], np.int64))
                sizes.append(np.full(n, k, np.int64))
        table = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.table, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(own)], 1), axis=0) if len(table) else np.zeros((0, 2), np.int64)
        self.owner, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.table) + 1))
        self.length = (self.table > 0).sum(1)
        self.shortest, self.longest = (int(self.length.min()), int(self.length.max())) if len(self.length) else (0, 0)

    def owners(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, item place): the items of windows, which being the place among the windows given."""
        n = self.first[windows + 1] - self.first[windows]
        which = np.repeat(np.arange(len(windows)), n)
        return which, self.owner[np.repeat(self.first[windows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; s ends with a unique smallest 0."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, k = len(s), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[sa] = np.cumsum(np.diff(key[sa], prepend=key[sa[:1]]) != 0)
        rank = new
        k *= 2
        if rank[sa[-1]] == n - 1 or k >= n:
            return sa


class WaveletTree:
    """Rank of a symbol in a prefix, by one bit vector with running counts per bit of the alphabet (a wavelet matrix)."""

    def __init__(self, s: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for k in range(self.bits - 1, -1, -1):
            bit = (s >> k) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(s) - ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start, end = np.zeros_like(end), end.copy()
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> k) & 1).astype(bool)
            a, b = self.ones[level][start], self.ones[level][end]
            start = np.where(one, self.zeros[level] + a, start - a)
            end = np.where(one, self.zeros[level] + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        at, out = at.copy(), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            one = ones[at + 1] - ones[at]
            out = out * 2 + one
            at = np.where(one > 0, self.zeros[level] + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search and location over one shard's word ids (1 and more; 0 is added as the end)."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        s = np.append(s, 0)
        self.n, self.top = len(s), int(s.max())
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.tree = WaveletTree(bwt, self.top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=self.top + 1))])
        marked = sa % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def search(self, table: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges [lo, hi) of all patterns, each read from its last word to its first."""
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), self.n, np.int64)
        for back in range(1, int(length.max(initial=0)) + 1):
            go = np.flatnonzero((length >= back) & (lo < hi))
            c = table[go, length[go] - back]
            fits = c <= self.top
            lo[go[~fits]] = hi[go[~fits]] = 0
            go, c = go[fits], c[fits]
            lo[go], hi[go] = self.before[c] + self.tree.rank(c, lo[go]), self.before[c] + self.tree.rank(c, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the transform to a sampled position."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = at[left]
            found = self.marks[here + 1] > self.marks[here]
            done = left[found]
            out[done] = self.samples[self.marks[at[done]]] + steps[done]
            left = left[~found]
            c = self.tree.access(at[left])
            at[left] = self.before[c] + self.tree.rank(c, at[left])
            steps[left] += 1
        return out


class Shard:
    """Documents gathered for one index."""

    def __init__(self, patterns: Patterns):
        self.p, self.parts, self.places, self.n_docs, self.size = patterns, [], [], 0, 0

    def add(self, words: list[bytes]) -> None:
        get = self.p.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words)) if self.p.ids else np.zeros(len(words), np.int64)
        at = np.flatnonzero(ids)
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            starts, ends = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts - 1, [len(at) - 1]])] + 1
            long = ends - starts >= self.p.shortest
            starts, sizes = starts[long], (ends - starts)[long]
            if len(starts):
                total = int(sizes.sum()) + len(sizes)
                where = np.repeat(starts - np.cumsum(np.concatenate([[0], sizes[:-1] + 1])), sizes + 1) + np.arange(total)  # each run and one separator
                run = np.append(ids, 0)[np.minimum(where, len(ids))]
                run[np.cumsum(sizes + 1) - 1] = 0
                self.parts.append(run)
                self.places.append(np.stack([np.full(total, self.n_docs), where]))
                self.size += total
        self.n_docs += 1

    def hits(self) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
        """By document: the items with an occurring window, and the merged spans of hit words [start, end)."""
        items, spans = [[] for _ in range(self.n_docs)], [[] for _ in range(self.n_docs)]
        if not self.size:
            return items, spans
        separator = len(self.p.ids) + 1
        s = np.concatenate(self.parts)
        s[s == 0] = separator
        doc, place = np.concatenate(self.places, axis=1)
        index = FMIndex(s)
        lo, hi = index.search(self.p.table, self.p.length)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(rows)
        d, first, last = doc[at], place[at], place[at] + self.p.length[which]
        met = np.unique(np.stack([d, which], 1), axis=0)
        of, owner = self.p.owners(met[:, 1])
        met = np.unique(np.stack([met[of, 0], owner], 1), axis=0)
        for i, k in met.tolist():
            items[i].append(self.p.items[k])
        order = np.lexsort((first, d))
        for i, a, b in zip(d[order].tolist(), first[order].tolist(), last[order].tolist(), strict=True):
            if spans[i] and a <= spans[i][-1][1]:
                spans[i][-1] = (spans[i][-1][0], max(b, spans[i][-1][1]))
            else:
                spans[i].append((a, b))
        return items, spans


def _pattern_files(benchmark: DataFrame, window: int, block_bytes: int, folder: str) -> list[str]:
    """Files of Patterns, each of about block_bytes of benchmark text, made in tasks; a file name for each block of the benchmark."""
    spark = benchmark.sparkSession
    rows = benchmark.filter("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    files.make_dir(folder)

    def build(table: pa.Table) -> pa.Table:
        path = f"{folder}/block-{table.column('block')[0].as_py():06d}"
        items = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda x: (_nulls_last(x[0]), x[1]))
        files.commit(path, pickle.dumps(Patterns(items, window)))
        return pa.table({"path": [path]})

    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", F.xxhash64("text")), F.lit(blocks)))
    found = rows.groupBy("block").applyInArrow(build, "path string").collect()  # a name for each block
    return sorted(r.path for r in found)


@lru_cache(1)
def _patterns(path: str) -> Patterns:
    """The patterns of a file of this library's own work folder; a worker holds one at a time."""
    return pickle.loads(files.read(path))


SPANS = "array<struct<start:int,end:int>>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted and merged spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(texts: list[bytes | None], paths: list[str]) -> tuple[list[int], list[list], list[list[tuple[int, int]]]]:
    """By text: its words, the items with an occurring window, the merged spans. Blocks of the benchmark are searched one after another, each with indexes of bounded size."""
    n_words, items, spans = [0] * len(texts), [set() for _ in texts], [[] for _ in texts]

    def search(shard: Shard, first: int) -> None:
        for i, (x, s) in enumerate(zip(*shard.hits(), strict=True)):
            items[first + i] |= set(x)
            spans[first + i] += s

    for path in paths:
        shard, first = Shard(_patterns(path)), 0
        for i, text in enumerate(texts):
            words = words_of(text)
            n_words[i] = len(words)
            shard.add(words)
            if shard.size >= SHARD_WORDS:
                search(shard, first)
                shard, first = Shard(_patterns(path)), i + 1
        search(shard, first)
    if not paths:
        n_words = [len(words_of(t)) for t in texts]
    return n_words, [sorted(x, key=_nulls_last) for x in items], [_merged(s) if len(paths) > 1 else s for s in spans]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where benchmark windows occur in whole document texts.

    Returns the columns in keep (default doc_id) with n_words, n_hit (words inside any occurrence),
    items (sorted item_ids with an occurring window) and spans (merged removal spans of words, end
    exclusive). Null and empty texts have no words, and items without words have no window. Equal
    items count each; those of a null item_id hit as all others and are one null, the last, in items.
    An empty benchmark hits nothing. Columns named like the new ones are replaced. Rows are
    searched on their own, so repeated rows and ids are fine. The benchmark may have any size: it is
    cut into blocks of block_bytes, and a run of documents is searched for one block after another,
    so a task holds the windows of one block.
    """
    arrow_rows(docs.sparkSession)
    new = ("n_words", "n_hit", "items", "spans")
    names = [c for c in (keep or ["doc_id"]) if c not in new]
    paths = _pattern_files(benchmark, window, block_bytes, shared_dir(docs.sparkSession))
    schema = T.StructType([*docs.select(*names).schema, *T.StructType.fromDDL(f"n_words bigint, items array<bigint>, spans {SPANS}")])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(texts: list[bytes | None], kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, items, spans = _hits(texts, paths)
            i = 0
            for b in kept:
                j = i + len(b)
                spoken = pa.array([[{"start": x, "end": y} for x, y in s] for s in spans[i:j]], span_type)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n[i:j], pa.int64()), pa.array(items[i:j], pa.list_(pa.int64())), spoken], names=[*names, "n_words", "items", "spans"])
                i = j

        texts, kept, held = [], [], 0
        for b in batches:
            texts += b.column("_text").cast(pa.binary()).to_pylist()
            kept.append(b.select(names))
            held += b.column("_text").nbytes
            if len(texts) >= SHARD_DOCS or held >= SHARD_BYTES:
                yield from out(texts, kept)
                texts, kept, held = [], [], 0
        if kept:
            yield from out(texts, kept)

    out = docs.select(*names, F.col("text").alias("_text")).mapInArrow(tidy(run), schema)
    width = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s.end - s.start).cast("long"))
    return out.select(*names, "n_words", width.alias("n_hit"), "items", "spans")


def items_digest(items: Column) -> Column:
    """SHA-256 of the item ids, sorted as strings, joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)

