"""Token shards: exact ids, exact round trip, random access."""

import random
import zlib

import numpy as np
import pytest

from siftwood.llm import token_ids as t


@pytest.fixture(scope="module")
def encoder():
    return t.Encoder.of(t.default_tokenizer())


ODD = ["", "a", " ", "  ", "a  b", "a   b", "x\n  y", " x", "x  ", "x \n y\n", "it's  we'll <|endoftext|> ok", "　 　a", "é  b", "tab\t x", "\n \n", "x\n ", "a" * 300 + " b", "1 2 3\r\n 4", "    z", "end\n", "a \nb", "mixed \n\n b", "\U0001f600 \U0001f600"]


def test_encoder_equals_the_library(encoder):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["ab", " ", "\n", "C.", "ü", "7", "'s", "\t", " the"]) for _ in range(rng.randrange(30))) for _ in range(800)]
    for got, want in zip(encoder(texts), encoder._plain(texts), strict=True):
        assert np.array_equal(got, want)


def test_re_pair_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 5), (2, 2), (5000, 3), (5000, 1), (20000, 700)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        symbols, rules = t.re_pair(ids, 1000, least=2)
        assert np.array_equal(t.decoded(symbols, t.expansions(rules, 1000)), ids)
    symbols, rules = t.re_pair(np.tile(np.arange(8, dtype=np.uint32), 1000), 1000)
    assert len(symbols) < 1000 and len(rules)
    symbols, rules = t.re_pair(np.tile(np.arange(8, dtype=np.uint32), 1000), 70_000)  # wider symbols
    assert np.array_equal(t.decoded(symbols, t.expansions(rules, 70_000)), np.tile(np.arange(8), 1000))


def test_re_pair_goes_on_until_no_pair_is_frequent():
    ids = np.tile(np.arange(8, dtype=np.uint32), 1000)
    symbols, rules = t.re_pair(ids, 1000)
    assert np.array_equal(t.decoded(symbols, t.expansions(rules, 1000)), ids)
    assert len(symbols) <= 32 and max(np.unique(symbols[:-1] * 2000 + symbols[1:], return_counts=True)[1]) < 2 * t.LEAST_COUNT


def test_table(spark, encoder, tmp_path):
    docs = [(i, x) for i, x in enumerate(ODD)] + [(100, "the cat " * 4000), (101, None), (102, "the cat"), (102, "the cat"), (None, "no id")]
    df = spark.createDataFrame([(i, x, 1) for i, x in docs], "doc_id long, text string, start int").repartition(3)
    manifest = t.write_shards(df, f"file://{tmp_path}/ids", shard_ids=500)
    rows = sorted(t.read_shards(manifest).collect(), key=lambda r: r.start)
    at, every = 0, []
    for r, (i, x) in zip(rows, sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")), strict=True):
        ids = np.append(encoder._plain([x or ""])[0], np.uint32(2)).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        assert np.array_equal(t.read_ids(r.path, r.shard_start, r.shard_start + r.n_tokens), ids)
        at += len(ids)
        every.append(ids)
    assert manifest.count() > 1
    long = max(rows, key=lambda r: r.n_tokens)
    whole = every[rows.index(long)]
    for a, b in ((0, 10), (1023, 1025), (5000, 5001), (3000, 9000), (7999, 8100)):
        assert np.array_equal(t.read_ids(long.path, long.shard_start + a, min(long.shard_start + b, long.shard_start + len(whole))), whole[a:b])
    assert not list((tmp_path / "ids").glob("*.tmp"))


def test_damage_is_noticed():
    data = bytearray(t.shard_bytes([1], [np.arange(50, dtype=np.uint32)], 1000))
    t.shard_arrays(bytes(data))
    data[-3] ^= 1
    with pytest.raises(ValueError):
        t.shard_arrays(bytes(data))


def test_empty_table(spark):
    assert t.token_table(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_re_pair_ends_on_long_diverse_texts():
    """Millions of ids whose buckets are full although no pair is frequent, alone and before repeats."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 12_000_000).astype(np.uint32)
    symbols, rules = t.re_pair(ids, 50_257)
    assert not len(rules) and np.array_equal(symbols, ids)
    ids = np.concatenate([ids[:6_000_000], np.tile(np.arange(100, dtype=np.uint32), 1000)])
    symbols, rules = t.re_pair(ids, 50_257)
    assert len(rules) and len(symbols) < 6_010_000 and np.array_equal(t.decoded(symbols, t.expansions(rules, 50_257)), ids)


def test_encoder_holds_little_and_grows_with_its_pieces():
    encoder = t.Encoder(t.default_tokenizer())
    texts = [" ".join(f"w{i}x" for i in range(a, a + 5000)) for a in range(0, 60_000, 5000)]
    held = lambda: sum(x.nbytes for x in (encoder.table, encoder.slot, encoder.powers.power, encoder.powers.inverse))
    encoder(texts[:1])
    assert held() < 6 << 20  # 45 MB before, whatever the texts
    for got, want in zip(encoder(texts), encoder._plain(texts), strict=True):
        assert np.array_equal(got, want)
    assert 2 * encoder.held <= len(encoder.table) and encoder.held > 50_000
