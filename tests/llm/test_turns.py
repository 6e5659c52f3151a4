import hashlib
import random

from siftwood.llm import turns

COLUMNS = "conv_id long, turn long, role string, text string, event string, at string"


def brute(rows, batches, idle):
    """Events of whole conversations, turn by turn and batch by batch."""
    sent = {}
    for conv, turn, role, text, *_ in rows:
        if turn is None:
            continue
        h = int(hashlib.sha256(f"{'' if conv is None else conv}:{turn}".encode()).hexdigest()[:8], 16)
        for b, r in [(h % batches, role or "")] + ([((h + batches // 2) % batches, "user")] if h % 7 < 2 else []):
            new = (f"{r}|{text or ''}", r)
            key = (conv, b, turn)
            sent[key] = min(sent.get(key, new), new, key=lambda x: (x[0].encode(), x[1].encode()))
    out = []
    for conv in {k[0] for k in sent}:
        first = min(k[2] for k in sent if k[0] == conv)
        kept, upto, last, closed = {}, first, None, False
        for b in range(batches):
            now = {k[2]: v for k, v in sent.items() if k[:2] == (conv, b)}
            if closed:
                out += [("reject", conv, t, b, p, None, None, None) for t, (p, _) in now.items()]
                continue
            for t, v in now.items():
                kept.setdefault(t, v)
                last = b
            while upto in kept:
                out.append(("release", conv, upto, b, kept[upto][0], None, None, None))
                upto += 1
            closed = last is not None and b - last >= idle
            if closed or b == batches - 1 and last is not None:
                breaks = sum(t - 1 in kept and kept[t - 1][1] == kept[t][1] for t in kept)
                out.append(("close", conv, -1, b if closed else batches, None, sorted(t for t in kept if t >= upto), max(kept) - first + 1 - len(kept), breaks))
    return sorted(map(str, out))


def events(df):
    return sorted(str((r.event, r.conv_id, r.turn, r.batch, r.payload, None if r.unreleased is None else list(r.unreleased), r.n_missing, r.n_breaks)) for r in df.collect())


def test_events_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([t, t, t + 3, t - 2]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "é", "", None, "x|y"]), "clash", "clash") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(7, 1, "user", "b", "", ""), (7, 1, "user", "b", "", ""), (7, None, "user", "lost", "", ""), (None, 0, "user", "no name", "", ""), (None, 2, None, None, "", "")]
    rows += [(50, 0, "user", "long " * 100_000, "", "")] + [(60, t, "user", str(t), "", "") for t in range(300)]  # one conversation of many turns
    table = spark.createDataFrame(rows, COLUMNS)
    assert events(turns.reassemble(turns.dealt_arrivals(table, 5), 5, 1)) == brute(rows, 5, 1)


def test_no_rows_no_events(spark):
    assert turns.reassemble(turns.dealt_arrivals(spark.createDataFrame([], COLUMNS), 1), 1).count() == 0
