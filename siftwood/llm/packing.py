"""Documents packed into sequences of a fixed number of tokens by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, saved, shared_dir, tidy
from .token_ids import GROUP, Encoder

#: Tokens of a sequence, and the id that ends each document.
SEQUENCE, END_ID = 4096, 1
#: Tokens, and pieces, that one task packs, about.
PART_TOKENS, PART_PIECES = 16_000_000, 400_000
_SPACES = bytes.maketrans(b"\t\n\r", b"   ")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(Encoder):
    """Ids of whole texts by a tokenizer that drops white space: those of the pieces between white space, one after another."""

    _made: dict = {}

    def _pieces(self, words: list[str]) -> list[np.ndarray]:
        each = self._plain(words)
        return [np.concatenate(each), np.array([len(x) for x in each], np.int64)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        found: dict[int, list] = {}
        group, size = [], 0

        def flush() -> None:
            nonlocal group, size
            for (i, _), x in zip(group, self._group([(raw, False) for _, raw in group]), strict=True):
                found[i].append(x)
            group, size = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            raw, at = t.encode().translate(_SPACES), 0
            found[i] = []
            while at <= len(raw):  # long texts in parts that end before a space
                end = raw.find(b" ", at + GROUP) if at + GROUP < len(raw) else len(raw)
                end = len(raw) if end < 0 else end
                group.append((i, raw[at:end]))
                size, at = size + end - at, end + 1
                if size >= GROUP:
                    flush()
        if group:
            flush()
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        for i, parts in found.items():
            out[i] = self._plain([texts[i]])[0] if any(x is None for x in parts) else np.concatenate(parts)
        return out


def cut_pieces(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text): doc_id, piece (from 0), start (its document's ids before it), length, ids_crc32, and ids (unsigned 16- or 32-bit) if wanted.

    A document is its ids and the end id, cut only where it is longer than a sequence; a null text is empty. Each row is a
    document, whatever its doc_id; other columns are ignored. The crc is that of the ids as little-endian unsigned 32-bit integers.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(path)
        small = encode.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        for b in batches:
            rows, piece, start, size, crc, kept = [], [], [], [], [], []
            for i, x in enumerate(encode([t or "" for t in b.column("text").to_pylist()])):
                ids = np.append(x, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype("<u2" if small else "<u4").tobytes())
            columns = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    arrow_rows(docs.sparkSession, 256)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken in the given order.

    With n(g) open bins of residual gap g, an item goes to the open bin after which the sum of n(g)**2 is
    smallest, to the one of the smallest gap among equals; a bin is opened only if the item fits into none. A
    full bin is closed. So the last item of a bin opened later fits into no earlier one, and one bin at most
    ends half empty.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: dict[int, list[int]] = {}
    where, offset, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        gaps = s + np.flatnonzero(count[s:capacity])
        if len(gaps):
            change = 2 * (count[gaps - s] - count[gaps]) + 2
            if gaps[0] == s:  # the bin is closed
                change[0] = 1 - 2 * count[s]
            gap = int(gaps[np.argmin(change)])
            count[gap] -= 1
            number = bins[gap].pop()
        else:
            gap, number, opened = capacity, opened, opened + 1
        where[i], offset[i] = number, capacity - gap
        if gap > s:
            count[gap - s] += 1
            bins.setdefault(gap - s, []).append(number)
    return where, offset


def pack(pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset: no sequence is longer than length, none has a gap before its end.

    pieces: length and any other columns but part, sequence_id and offset. Pieces as long as a sequence are one.
    The others are dealt to parts of some PART_TOKENS tokens and PART_PIECES pieces, by their place in the table,
    so equal rows are dealt evenly too; each part is packed by falling length, and one sequence of a part at most is less than half full.
    The pieces must be a written table, whose rows keep their places if a task is repeated. An empty table gives no rows.
    """
    held = pieces.withColumn("place", F.monotonically_increasing_id())
    rest = held.filter(F.col("length") < length)
    size = rest.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    parts = max(1, -(-size.tokens // PART_TOKENS), -(-size.n // PART_PIECES))

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        table = table.sort_by([("length", "descending"), ("place", "ascending")])
        where, offset = sum_of_squares(table.column("length").to_numpy(), length)
        return table.drop_columns(["part", "place"]).append_column("sequence_id", pa.array(where + (part << 40))).append_column("offset", pa.array(offset))

    packed = rest.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = packed.groupBy("part").applyInArrow(run, f"{fields}, sequence_id long, offset long")
    whole = held.filter(F.col("length") == length).withColumn("sequence_id", -1 - F.col("place")).withColumn("offset", F.lit(0).cast("long")).drop("place")
    return packed.unionByName(whole)


def packed_documents(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """All documents of docs(doc_id, text) as pieces packed into sequences; see cut_pieces and pack."""
    pieces = saved(cut_pieces(docs, length, tokenizer, end_id, keep_ids), f"{shared_dir(docs.sparkSession)}/pieces")
    return pack(pieces, length)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, its pieces one after another: sequence_id, n_tokens, ids (binary). packed must hold ids; a group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    held = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return held.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
