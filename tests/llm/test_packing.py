import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftwood.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


ODD = ["", " ", "  ", "a  b", "A\tB\nC\r\nd", "it's we'LL", "<|endoftext|> x<|startoftext|>y", "é é ́a", "ΟΔΟΣ ΣΣ", "a b c\x0bd\x1ce", "x" * 700 + " b", "\U0001f600 \U0001f600!!", "1234 5 ½", "a b " * 3000, "... ,,a,b"]


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["Ab", " ", "\n", "C.", "ü", "7", "'s", "\t", " the", "<|endoftext|>", " "]) for _ in range(rng.randrange(30))) for _ in range(500)]
    for text, got in zip(texts, packing.WordEncoder.of(packing.default_tokenizer())(texts), strict=True):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def plain_rule(sizes, capacity):
    """The sum-of-squares rule word by word."""
    gaps, out = [], []  # residual gap of each bin; bin of each item
    count = lambda: sum(sum(g == x for g in gaps) ** 2 for x in set(gaps) - {0})
    for s in sizes:
        fit = [b for b, g in enumerate(gaps) if g >= s]
        best = None
        for b in fit:
            gaps[b] -= s
            now = (count(), gaps[b])
            gaps[b] += s
            best = min(best, (*now, b)) if best else (*now, b)
        if best is None:
            gaps.append(capacity)
            best = (0, 0, len(gaps) - 1)
        out.append((best[:2] if fit else None, gaps[best[2]]))
        gaps[best[2]] -= s
    return [g for _, g in out], len(gaps)


def test_rule_equals_brute_force():
    rng = random.Random(2)
    for capacity in (10, 37):
        sizes = [rng.randint(1, capacity - 1) for _ in range(200)]
        gaps, bins = plain_rule(sizes, capacity)
        where, offset = packing.sum_of_squares(np.array(sizes), capacity)
        assert [capacity - o for o in offset.tolist()] == gaps and len(set(where.tolist())) == bins


def whole(rows, length):
    """Sequences have no gap and no piece twice; all but one of each part are more than half full."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return by


def test_documents_packed(spark, tokenizer):
    rng = random.Random(4)
    docs = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(100 + i, "word " * rng.randint(0, 400), "y", 2) for i in range(300)] + [(7, "twice", "", 0), (7, "twice", "", 0), (None, None, "", 0), (None, "no id", "", 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, part string, sequence_id int")
    packed = packing.packed_documents(table, 256, keep_ids=True)
    rows = packed.collect()
    want = []
    for doc_id, text, *_ in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(doc_id, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = whole(rows, 256)
    assert len(by) <= -(-sum(r.length for r in rows) // 256) + 1
    full = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    r = rows[0]
    ids = np.frombuffer(full[r.sequence_id].ids, "<u2")[r.offset : r.offset + r.length]
    assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32 and sum(x.n_tokens for x in full.values()) == sum(r.length for r in rows)


def test_many_parts_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 50)
    table = spark.createDataFrame([(i, "a b c d " * (i % 40)) for i in range(400)], "doc_id long, text string")
    rows = packing.packed_documents(table, 128).collect()
    by = whole(rows, 128)
    assert sum(r.length for r in rows) == sum(4 * (i % 40) + 1 for i in range(400)) and len(by) <= -(-sum(r.length for r in rows) // 128) + 9
    assert packing.packed_documents(table.limit(0)).count() == 0
