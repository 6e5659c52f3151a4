"""Streams with keyed state, fed in slices with a start for each."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from siftwood.plans import streams as plans
from siftwood.streaming import feeds, keyed
from siftwood.streaming import state as streams

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


FRAMES = "peer string, txid long, ts timestamp, seq long, kind string, n long, most_symbols long, element_bytes int"


def test_sessions(spark):
    rows = [
        ("a", 1, at(0), 0, "begin", None, 150, 32), ("a", 1, at(1), 1, "symbols", 100, None, None), ("a", 1, at(2), 2, "symbols", 100, None, None), ("a", 1, at(3), 3, "need", 5, None, None),
        ("a", 1, at(4), 4, "symbols", 1, None, None), ("a", 1, at(5), 5, "records", 5, None, None), ("a", 1, at(6), 6, "end", None, None, None), ("a", 1, at(7), 7, "need", 1, None, None),
        ("a", 2, at(0), 0, "begin", None, None, 16), ("a", 2, at(1), 1, "end", None, None, None), ("b", 1, at(0), 0, "begin", None, 0, 32), ("b", 1, at(1), 1, "need", 1001, None, None),
        ("b", 1, at(2), 2, "records", 501, None, None), ("b", 1, at(3), 3, "begin", None, 9999, 32), ("b", 1, at(4), 4, "symbols", 2000, None, None), ("b", 1, at(50), 5, "symbols", 1, None, None),
        ("c", 1, at(60), 0, "begin", None, None, 32), ("c", 1, at(61), 1, "odd", None, None, None), (None, None, at(62), 0, "begin", None, None, 32), (None, None, at(63), 0, "end", None, None, None),
        ("d", 1, None, 0, "begin", None, None, 32), ("e", 1, at(200), 0, "begin", None, None, 32),
    ]
    table = feeds.time_slices(spark.createDataFrame(rows, FRAMES), "ts", 2)
    got = {(r.peer, r.txid, r.seq, r.event, r.detail, r.symbols, r.records, r.refused) for r in feeds.fed(table, 2, lambda s: keyed.sessions(s, 30)).collect()}
    assert got == {
        ("a", 1, 2, "refused", "budget", None, None, None), ("a", 1, 4, "refused", "phase", None, None, None), ("a", 1, 6, "ended", "fulfilled", 100, 5, 2), ("a", 1, 7, "refused", "unknown_session", None, None, None),
        ("a", 2, 0, "refused", "element_size", None, None, None), ("b", 1, 1, "refused", "too_many_ids", None, None, None), ("b", 1, 2, "refused", "too_many_records", None, None, None),
        ("b", 1, 3, "replaced", "begun", 0, 0, 2), ("b", 1, 4, "expired", "symbols", 2000, 0, 0), ("b", 1, 5, "refused", "unknown_session", None, None, None),
        ("c", 1, 1, "refused", "unknown_frame", None, None, None), ("c", 1, 1, "expired", "begun", 0, 0, 1), (None, None, 0, "ended", "begun", 0, 0, 0),
    }


def test_sessions_of_a_group_share_their_state():
    import pandas as pd

    calls = []

    class Handle:
        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a))

    held = keyed.Sessions(30, 2000)
    held.init(Handle())
    rows = [("p", i, True, i * 1_000_000, i, True, "begin", 0, 0, 32) for i in range(20)]
    t = pd.DataFrame(rows, columns=["peer", "txid", "has_txid", "at", "seq", "has_seq", "kind", "n", "most_symbols", "element_bytes"])
    assert sum(map(len, held.handleInputRows((0,), iter([t[:5], t[5:]]), None))) == 0
    assert [c[0] for c in calls] == ["get", "registerTimer", "update"]
    assert calls[1][1] == 30_000 and len(calls[2][1][1]) == 20


def book(contacts, new_places, tried_places):
    fresh, tried, out = {}, {}, []
    for node, peer, _, seq, kind in contacts:
        f, t = fresh.setdefault(node, {}), tried.setdefault(node, {})
        e, gone, action = t.get(peer) or f.get(peer), None, "ignored"
        if kind == "seen":
            action = "known" if e else "added"
            if not e:
                if len(f) >= new_places:
                    gone = next(iter(f))
                    del f[gone]
                e = f[peer] = [0, 0]
        elif e and kind == "answered":
            action = "refreshed" if peer in t else "promoted"
            (t if peer in t else f).pop(peer)
            if action == "promoted" and len(t) >= tried_places:
                gone = next(iter(t))
                del t[gone]
            e[0] += 1
            t[peer] = e
        elif e and kind == "failed":
            action = "failed"
            e[1] += 1
        elif e and kind == "closed":
            action = "removed"
            (t if peer in t else f).pop(peer)
            e = None
        out.append((node, seq, peer, action, gone, e and e[0], e and e[1], len(f), len(t)))
    return out


def test_peer_books(spark):
    rng = random.Random(1)
    contacts = [(rng.choice("xyz"), rng.choice("abcdefghijklmno"), at(i // 2), i, rng.choice(["seen", "seen", "answered", "failed", "closed", "odd"])) for i in range(900)]
    table = feeds.time_slices(spark.createDataFrame(contacts, "node string, peer string, ts timestamp, seq long, kind string"), "ts", 3)
    got = [(r.node, r.seq, r.peer, r.action, r.evicted, r.successes, r.failures, r.n_new, r.n_tried) for r in feeds.fed(table, 3, lambda s: keyed.peer_books(s, 4, 3)).orderBy("seq").collect()]
    assert got == book(contacts, 4, 3)


def test_record_caches(spark):
    rng = random.Random(2)
    changes = [(rng.choice("xy"), rng.choice("abcdefghijkl"), i, at(i), i, rng.choice(["add", "add", "add", "remove"])) for i in range(600)]
    table = feeds.time_slices(spark.createDataFrame(changes, "cache string, id string, t long, ts timestamp, seq long, kind string"), "ts", 3)
    held, queue, want = {"x": set(), "y": set()}, {"x": [], "y": []}, []
    for c, i, _, _, seq, kind in changes:
        gone, action = None, "ignored"
        if kind == "add" and i in held[c]:
            action = "repeated"
        elif kind == "add":
            action = "added"
            while len(held[c]) >= 5:
                first = queue[c].pop(0)
                if first in held[c]:
                    held[c].remove(first)
                    gone = first
                    break
            held[c].add(i)
            queue[c].append(i)
        elif i in held[c]:
            action = "removed"
            held[c].remove(i)
        want.append((c, seq, i, action, gone, len(held[c])))
    got = feeds.fed(table, 3, lambda s: keyed.record_caches(s, 5))
    assert [(r.cache, r.seq, r.id, r.action, r.evicted, r.n_held) for r in got.orderBy("seq").collect()] == want


@pytest.mark.parametrize("slices", [1, 2])
def test_deadlines(spark, slices):
    rows = [(0, "p", at(0), 1.0, False), (1, "p", at(10), 3.0, True), (2, "p", at(20), 4.0, False), (3, "q", at(30), None, False), (4, "q", at(9000), 0.0, False)]
    table = feeds.time_slices(spark.createDataFrame(rows, "txid long, peer string, ts timestamp, after double, rejected boolean"), "ts", slices)

    def plan(s):
        answers = s.filter("after is not null").selectExpr("txid", "peer", "timestamp_micros(unix_micros(ts) + cast(after * 1000000 as long)) answered_at", "rejected")
        return streams.gathered_stream(s.selectExpr("txid", "peer", "ts asked_at"), answers, 3).select("txid", "outcome")

    assert {tuple(r) for r in feeds.fed(table, slices, plan).collect()} == {(0, "answered"), (1, "rejected"), (2, "timeout"), (3, "timeout"), (4, "answered")}


def test_no_rows(spark):
    table = feeds.time_slices(spark.createDataFrame([], "node string, peer string, ts timestamp, seq long, kind string"), "ts", 2)
    assert feeds.fed(table, 2, keyed.peer_books).count() == 0


def test_deadlines_of_the_last_minute_are_told(spark, tmp_path):
    rows = ", ".join(f"({i}, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {i * 10}), {i % 5})" for i in range(40))
    spark.sql(f"select cast(c1 as long) event_id, c2 ts, cast(c3 as long) user_id from values {rows} as t(c1, c2, c3)").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(plans.ORACLES["stream_deadlines"]).fetchall()
    assert len(want) == 20 and (36, "1", "timeout") in want
    assert sorted(tuple(r) for r in plans.QUERIES["stream_deadlines"](spark, str(tmp_path)).collect()) == sorted(want)


def test_a_cache_asks_its_state_once_for_each_id():
    from pyspark.sql import Row

    class Held(dict):
        calls = 0

        def containsKey(self, k):
            self.calls += 1
            return k in self

        def getValue(self, k):
            self.calls += 1
            return self[k]

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

        def removeKey(self, k):
            self.calls += 1
            del self[k]

    class Ends:
        now = None
        exists = lambda self: self.now is not None
        get = lambda self: self.now

        def update(self, v):
            self.now = v

    rnd = random.Random(1)
    rows = [Row(id=str(rnd.randrange(12)), t=i, ts=at(i), seq=i, kind=rnd.choice(["add", "add", "remove"])) for i in range(3000)]
    runs = []
    for step in (1, 1000):  # a batch for each row, and large batches
        cache = keyed.RecordCache(4)
        cache.held, cache.queue, cache.ends = Held(), Held(), Ends()
        runs.append(([tuple(r) for i in range(0, len(rows), step) for r in cache.handleInputRows(("c",), iter(rows[i : i + step]), None)], dict(cache.held), dict(cache.queue), cache.ends.now))
    assert runs[0] == runs[1] and len(runs[1][0]) == 3000
    assert cache.held.calls + cache.queue.calls < 300
