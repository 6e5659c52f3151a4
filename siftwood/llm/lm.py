"""Language-model scores by a weighted backoff automaton over corpus-wide n-gram counts.

The model is a smoothed trigram model:

* P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
* P(w|v) = (c(v,w) + MU * P(w)) / (c(v) + MU),
* P(w|u,v) = (max(c(u,v,w) - DISCOUNT, 0) + DISCOUNT * T(u,v) * P(w|v)) / c(u,v), T being the number of
  distinct words that follow the pair; where the pair was never seen, P(w|v).

As an automaton, every seen word and every seen pair is a state, besides the root; a seen n-gram is an
arc that carries its smoothed log-probability; a state's failure arc leads to the state of the
history without its first word and carries log10 of what is left for unseen words. A text runs
through it once from left to right: where the state has no arc for the word, failure arcs are
followed until one has.

Counts grow with the corpus, so no task holds them all. Blocks of documents send their distinct
n-grams to hash ranges; a range adds up the training counts and answers every block that asked; a block
then builds the automaton of just its own n-grams and runs its documents through it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import WordHashes, arrow_rows, mixed, packed, packed_sorted, saved, shared_dir, shuffle_partitions, tidy, trim, unpacked, unpacked_sorted

#: Weight of the unigram model, in observations of the context; discount of a trigram's count.
MU, DISCOUNT = 20.0, 0.9
#: Tokens of a block, about.
BLOCK_TOKENS = 1_500_000
#: Bytes of text for each hash range, beyond the session's shuffle partitions, and most ranges. Only ranges
#: that a block holds n-grams of get a row of it, so rows never outnumber n-grams.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 16
#: Tokens that one lane of the run takes, besides the two before them that bring it to its state.
LANE = 512
#: Hashes that no word is given on purpose: the end of a text, and what stands before its first word.
END, START = np.uint64(0x57AB1E00000001), np.uint64(0x57AB1E00000002)
#: Bits of the hashes of words and pairs, and of a word behind a known pair: what the shuffle carries.
HASH_BITS, BEHIND_BITS = 56, 32
_HASH, _BEHIND, _LOW = np.uint64((1 << HASH_BITS) - 1), np.uint64((1 << BEHIND_BITS) - 1), np.uint64(BEHIND_BITS)


def pair_keys(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + words) & _HASH


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the place of each key among them."""
    order = np.argsort(keys)
    sort = keys[order]
    new = np.concatenate([[True], sort[1:] != sort[:-1]]) if len(sort) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new) - 1
    return sort[new], place


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for name, a in arrays.items():
        data = packed(a)
        head = f"{name} {a.dtype.str} {len(data)}\n".encode()
        out.write(head + data)
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    while at < len(data):
        end = data.index(b"\n", at)
        name, kind, size = data[at:end].decode().split(" ")
        out[name] = unpacked(data[end + 1 : end + 1 + int(size)], kind)
        at = end + 1 + int(size)
    return out


class Grams:
    """The distinct n-grams of a run of texts: words by hash, pairs by hash, trigrams by the place of their pair and word."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        """words: hashes of all tokens; starts: where texts begin."""
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[starts] = START
        self.pairs, self.pair = distinct(pair_keys(words, before))
        third = np.ones(len(words), bool)  # tokens with a pair of this text before them
        third[starts] = False
        self.at = np.flatnonzero(third)
        self.trigrams, self.trigram = distinct(self.pair[self.at - 1].astype(np.uint64) << _LOW | words[self.at] & _BEHIND)


class Automaton:
    """States and arcs for the n-grams of one block.

    State 0 is the root, 1 + i the word i, the last of them the start of a text, and behind those come the pairs.
    """

    def __init__(self, grams: Grams, place: np.ndarray, starts: np.ndarray, words: np.ndarray, pairs: np.ndarray, after: np.ndarray, trigrams: np.ndarray, train_docs: int, n: int, v: int, mu: float = MU, discount: float = DISCOUNT):
        """place: word of every token; words, pairs, trigrams: training counts; after: distinct words behind each pair."""
        self.start = len(words) + 1
        unigram = (words + 0.5) / (n + 0.5 * (v + 1))
        self.root = np.log10(unigram)
        context = np.append(words, train_docs).astype(np.float64)
        first = np.empty_like(place)
        first[1:] = place[:-1]
        first[starts] = len(words)
        a, b = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        a[grams.pair], b[grams.pair] = first, place
        base = self.start + 1
        with np.errstate(divide="ignore", invalid="ignore"):
            second = (pairs + mu * unigram[b]) / (context[a] + mu)
            rest = discount * after / pairs
            self.failure = np.concatenate([[0.0], np.log10(mu / (context + mu)), np.log10(rest)])
        self.suffix = np.concatenate([np.zeros(base, np.int64), 1 + b])  # where failure arcs lead
        self.known = np.concatenate([[True], context > 0, pairs > 0])
        # Arcs: keys of (state, word), ascending, with weights and the states behind them.
        w = b[grams.pair[grams.at]]
        owner, last, behind = np.zeros(len(trigrams), np.int64), np.zeros(len(trigrams), np.int64), np.zeros(len(trigrams), np.int64)
        owner[grams.trigram], last[grams.trigram], behind[grams.trigram] = grams.pair[grams.at - 1], w, grams.pair[grams.at]
        two, three = np.flatnonzero(pairs > 0), np.flatnonzero(trigrams > 0)
        weight = (np.maximum(trigrams[three] - discount, 0) + discount * after[owner[three]] * second[behind[three]]) / pairs[owner[three]]
        keys = np.concatenate([(1 + a[two]) << 32 | b[two], (base + owner[three]) << 32 | last[three]])
        order = np.argsort(keys)
        self.keys, self.weight, self.to = keys[order], np.log10(np.concatenate([second[two], weight]))[order], (base + np.concatenate([two, behind[three]]))[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability, next state) of a word from each state: failure arcs are followed until an arc has the word."""
        total, after, left = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        state = state.copy()
        while len(left):
            here, w = state[left], word[left]
            at_root = here == 0
            done = left[at_root]
            total[done] += self.root[word[done]]
            after[done] = np.where(self.known[1 + word[done]], 1 + word[done], 0)
            left, here, w = left[~at_root], here[~at_root], w[~at_root]
            key = here << 32 | w
            arc = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            found = self.keys[arc] == key if len(self.keys) else np.zeros(len(left), bool)
            done = left[found]
            total[done] += self.weight[arc[found]]
            after[done] = self.to[arc[found]]
            left = left[~found]
            total[left] += self.failure[state[left]]
            state[left] = self.suffix[state[left]]
        return total, after

    def scores(self, place: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log-probabilities of texts. Lanes of a text run side by side; each but the first begins two tokens early at the root, which brings it to its state."""
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[text] + number * LANE
        end = np.minimum(begin + LANE, starts[text] + size[text])
        at = np.where(number > 0, begin - 2, begin)
        order = np.argsort(at - end, kind="stable")  # longest first, so that running lanes are a prefix
        text, begin, end, at = text[order], begin[order], end[order], at[order]
        start = self.start if self.known[self.start] else 0
        state, total = np.where(number[order] > 0, 0, start), np.zeros(len(text))
        running = len(text)
        while running:
            step, state[:running] = self.step(state[:running], place[at[:running]])
            total[:running] += np.where(at[:running] >= begin[:running], step, 0.0)
            at[:running] += 1
            running = int(np.searchsorted(-(end - at), 0))
        return np.bincount(text, total, len(size))


def _edges(ranges: int) -> np.ndarray:
    """First keys of the ranges but the first."""
    return np.array([(r << HASH_BITS) // ranges for r in range(1, ranges)], np.uint64)


def _frame(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def _requests(docs: DataFrame, folder: str, ranges: int) -> DataFrame:
    """Rows (range, path, words, grams): each block's distinct n-grams of a range with its training counts.

    Pairs lie in the range of their hash with the words that follow them. Blocks leave their texts, as
    places of their words, in files of fixed names.
    """
    files.make_dir(folder)
    names = ["range", "path", "words", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, edges = WordHashes(), TaskContext.get().partitionId(), _edges(ranges)
        seq, ids, missing, held, texts, size = 0, [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(t) for t in texts], np.int64)
            tokens = np.concatenate(texts)
            starts = np.cumsum(n) - n
            train = np.repeat(~np.array(held, bool), n)
            path, words, grams = f"{folder}/block-{part:06d}-{seq:06d}", {}, {}
            known, place = distinct(tokens)
            count = np.bincount(place[train], minlength=len(known)).astype(np.uint32)
            cuts = [0, *np.searchsorted(known, edges), len(known)]
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                words[r] = _frame(packed_sorted(known[a:b]), packed(count[a:b]))
            g = Grams(tokens, starts)
            two = np.bincount(g.pair[train], minlength=len(g.pairs)).astype(np.uint32)
            three = np.bincount(g.trigram[train[g.at]], minlength=len(g.trigrams)).astype(np.uint32)
            first = np.searchsorted(g.trigrams, np.arange(len(g.pairs) + 1).astype(np.uint64) << _LOW)  # trigrams of each pair
            cuts = [0, *np.searchsorted(g.pairs, edges), len(g.pairs)]
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                i, j = first[a], first[b]
                low = (g.trigrams[i:j] & _BEHIND).astype(np.uint32)
                grams[r] = _frame(packed_sorted(g.pairs[a:b]), packed(two[a:b]), packed(np.diff(first[a : b + 1]).astype(np.uint32)), packed(low), packed(three[i:j]))
            end = np.searchsorted(known, np.array([END])).astype(np.int64)
            files.commit(path, _dump(n=n, ids=np.array(ids, np.int64), missing=np.array(missing, np.uint8), held=np.array(held, np.uint8), known=known, place=place, end=end))
            used = sorted(words.keys() | grams.keys())
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([path] * len(used)), *[pa.array([x.get(r) for r in used], pa.binary()) for x in (words, grams)]], names=names)

        for b in batches:
            found = hashes.texts(b.column("text").cast(pa.binary()).to_pylist())
            for doc_id, out, h in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), found, strict=True):
                ids.append(doc_id or 0)
                missing.append(doc_id is None)
                held.append(bool(out))
                texts.append(np.append(h & _HASH, END))
                size += len(h) + 1
                if size >= BLOCK_TOKENS:
                    yield flush()
                    seq, ids, missing, held, texts, size = seq + 1, [], [], [], [], 0
        if texts:
            yield flush()

    return docs.select("doc_id", "text", "held_out").mapInArrow(tidy(run), "range int, path string, words binary, grams binary")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all requests with their total counts, and the place of each requested key among them."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    known, place = distinct(key)
    return known, np.bincount(place, count, len(known)).astype(np.int64), place


def _answers(requests: DataFrame) -> DataFrame:
    """Rows (path, range, words, grams, n, v): corpus-wide training counts in the order of each request; n, v of the range."""

    def answer(table: pa.Table) -> pa.Table:
        asked = [_parts(x) if x else None for x in table.column("words").to_pylist()]
        words, n, v = [b""] * table.num_rows, 0, 0
        if any(asked):
            keys = [unpacked_sorted(x[0], np.uint64) for x in asked if x]
            _, total, place = _summed(keys, [unpacked(x[1], np.uint32) for x in asked if x])
            n, v = int(total.sum()), int((total > 0).sum())
            found = iter(np.split(total[place].astype(np.uint32), np.cumsum([len(k) for k in keys])[:-1]))
            words = [packed(next(found)) if x else b"" for x in asked]
        asked = [_parts(x) if x else None for x in table.column("grams").to_pylist()]
        grams = [b""] * table.num_rows
        if any(asked):
            here = [x for x in asked if x]
            keys = [unpacked_sorted(x[0], np.uint64) for x in here]
            pairs, two, place = _summed(keys, [unpacked(x[1], np.uint32) for x in here])
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            sizes = [unpacked(x[2], np.uint32) for x in here]
            owner = [np.repeat(p, s).astype(np.uint64) for p, s in zip(np.split(place, cuts), sizes, strict=True)]
            trigrams, three, at = _summed([p << _LOW | unpacked(x[3], np.uint32) for p, x in zip(owner, here, strict=True)], [unpacked(x[4], np.uint32) for x in here])
            after = np.bincount((trigrams[three > 0] >> _LOW).astype(np.int64), minlength=len(pairs))
            two, again = (np.split(x[place].astype(np.uint32), cuts) for x in (two, two - after))  # most pairs are always followed by another word
            three = np.split(three[at].astype(np.uint32), np.cumsum([len(p) for p in owner])[:-1])
            found = iter(zip(two, again, three, strict=True))
            grams = [_frame(*map(packed, next(found))) if x else b"" for x in asked]
        rows = table.num_rows
        return pa.table({"path": table.column("path"), "range": table.column("range"), "words": pa.array(words, pa.binary()), "grams": pa.array(grams, pa.binary()), "n": pa.array([n] * rows, pa.int64()), "v": pa.array([v] * rows, pa.int64())})

    return requests.groupBy("range").applyInArrow(answer, "path string, range int, words binary, grams binary, n long, v long")


def ranges_for(spark: SparkSession, size: int) -> int:
    """Hash ranges for so many bytes of text."""
    return min(MOST_RANGES, max(shuffle_partitions(spark), -(-size // RANGE_BYTES)))


def score_texts(docs: DataFrame, mu: float = MU, discount: float = DISCOUNT) -> DataFrame:
    """Score all whole texts with a trigram model of the rows that aren't held out.

    docs: doc_id, text, held_out (null: false); other columns are ignored. Tokens are lower-case
    (A-Z) words between ASCII white space and one end token; null and empty texts have only the
    end. Repeated rows count and score each. Returns doc_id, held_out, n_tokens, n_known (tokens met
    in training), train_tokens, base_score (unigram log10 probability) and score (the model's). An
    empty table gives no rows; without training rows every token is unknown.

    Words and pairs are told apart by HASH_BITS bits, the words behind a pair by BEHIND_BITS. A range's n-grams
    are held by one task: beyond MOST_RANGES * RANGE_BYTES of text (1 TB) their size grows with the corpus.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    work = shared_dir(spark)
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers = saved(_answers(_requests(docs, f"{work}/blocks", ranges_for(spark, size))), f"{work}/answers")
    totals = answers.groupBy("range").agg(F.first("n").alias("n"), F.first("v").alias("v")).agg(F.sum("n"), F.sum("v")).first()
    n, v = totals[0] or 0, totals[1] or 0
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        joined = lambda arrays: np.concatenate([np.zeros(0, np.uint32), *arrays]).astype(np.int64)
        words = joined(unpacked(x, np.uint32) for x in table.column("words").to_pylist() if x)
        grams = [[unpacked(y, np.uint32) for y in _parts(x)] for x in table.column("grams").to_pylist() if x]
        two, again, three = (joined(x[i] for x in grams) for i in range(3))
        block = _load(files.read(table.column("path")[0].as_py()))
        length, place = block["n"], block["place"].astype(np.int64)
        starts = np.cumsum(length) - length
        auto = Automaton(Grams(block["known"][place], starts), place, starts, words, two, two - again, three, int(words[block["end"][0]]), n, v, mu, discount)
        known = np.add.reduceat((words[place] > 0).astype(np.int64), starts)
        rows = len(length)
        columns = [pa.array(block["ids"], mask=block["missing"].astype(bool)), pa.array(block["held"].astype(bool)), pa.array(length), pa.array(known), pa.array(np.full(rows, n, np.int64)), pa.array(np.add.reduceat(auto.root[place], starts)), pa.array(auto.scores(place, starts, length))]
        trim()
        return pa.Table.from_arrays(columns, names=names)

    return answers.select("path", "range", "words", "grams").groupBy("path").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
