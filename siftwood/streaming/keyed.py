"""Operators that keep bounded state for each key: sync sessions, peer books, record caches.

Rows of a key and batch are put in the order of (ts, seq) before they are applied; the number of rows in a batch is
bounded by the source's trigger. State is written back entry by entry, so a batch costs what it changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Limits of a session: symbols in all, and symbols, ids and records of a frame (fixed values of the protocol).
MOST_SYMBOLS, FRAME_SYMBOLS, FRAME_IDS, FRAME_RECORDS, ELEMENT_BYTES = 2000, 100, 1000, 500, 32
#: Phases of a session, in order.
PHASES = ("begun", "symbols", "needed", "fulfilled", "ended")
#: Places of a peer book for new and tried peers, and of a record cache.
NEW_PLACES, TRIED_PLACES, CACHE_PLACES = 1024, 256, 10_000


def _ordered(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.ts, r.seq))


SESSION_EVENTS = "peer string, txid long, at long, seq long, event string, detail string, symbols long, records long, refused long"
#: Sessions are kept in so many groups by a hash of their key; fixed for the life of a checkpoint.
SESSION_GROUPS = 512


class Sessions(StatefulProcessor):
    """The responder's state of the open sessions (peer, txid) of one group, as one list: a batch reads and writes it once, however many sessions it touches.

    A group has one timer, at or before the first time that one of its sessions has been idle for long enough.
    """

    def __init__(self, idle: int, most: int):
        self.idle, self.most = idle * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "timer long, held array<struct<peer:string,txid:long,phase:int,budget:long,symbols:long,records:long,refused:long,last:long,seq:long>>")

    def _held(self) -> tuple[int | None, dict[tuple, tuple]]:
        """The expiry of the group's timer and its sessions by (peer, txid)."""
        x = self.state.get()
        return (None, {}) if x is None else (x[0], {(h[0], h[1]): tuple(h)[2:] for h in x[1]})

    def _keep(self, timer: int | None, held: dict[tuple, tuple]) -> None:
        if not held:
            self.state.clear()  # a timer that is left finds nothing
            return
        first = (min(s[5] for s in held.values()) + self.idle) // 1000
        if timer is None or first < timer:
            self.handle.registerTimer(first)
            timer = first
        self.state.update((timer, [(*k, *s) for k, s in held.items()]))

    def _said(self, key: tuple, at: int, seq: int | None, event: str, detail: str | None, s: tuple | None) -> tuple:
        return (*key, at, seq, event, detail, *(s[2:5] if s else (None, None, None)))

    def _refusal(self, s: tuple | None, kind: str | None, n: int, element_bytes: int) -> str | None:
        """Why a frame is refused, or None."""
        if kind == "begin":
            return "element_size" if element_bytes != ELEMENT_BYTES else None
        if kind not in ("symbols", "need", "records", "end"):
            return "unknown_frame"
        if s is None:
            return None if kind == "end" else "unknown_session"
        if kind == "symbols":
            return "phase" if s[0] > 1 else "budget" if s[2] + n > s[1] else None
        if kind == "need":
            return "too_many_ids" if n > FRAME_IDS else None
        return "too_many_records" if kind == "records" and n > FRAME_RECORDS else None

    def _frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Frames in the order of (at, seq), those without a seq first."""
        t = pd.concat(list(rows), ignore_index=True)
        t = t.iloc[np.lexsort((t["seq"], t["has_seq"], t["at"]))]
        return zip(*(t[c].tolist() for c in ("peer", "txid", "has_txid", "at", "seq", "has_seq", "kind", "n", "most_symbols", "element_bytes")), strict=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (timer, held), out = self._held(), []
        for peer, txid, has_txid, at, seq, has_seq, kind, n, asked, element_bytes in self._frames(rows):
            k, seq = (peer, txid if has_txid else None), seq if has_seq else None
            s = held.get(k)
            if s is not None and at >= s[5] + self.idle:
                out.append(self._said(k, s[5], s[6], "expired", PHASES[s[0]], s))
                s = held.pop(k) and None
            why = self._refusal(s, kind, n, element_bytes)
            if why:
                out.append(self._said(k, at, seq, "refused", why, None))
                if s is not None:
                    held[k] = (*s[:4], s[4] + 1, at, seq)
            elif kind == "begin":
                if s is not None:
                    out.append(self._said(k, at, seq, "replaced", PHASES[s[0]], s))
                held[k] = (0, asked if 0 < asked < self.most else self.most, 0, 0, 0, at, seq)
            elif s is not None and kind == "end":
                out.append(self._said(k, at, seq, "ended", PHASES[s[0]], s))
                del held[k]
            elif s is not None:
                phase = {"symbols": 1, "need": 3, "records": 3}[kind]  # what a need asks for is answered at once
                held[k] = (phase, s[1], s[2] + n * (kind == "symbols"), s[3] + n * (kind == "records"), s[4], at, seq)
        self._keep(timer, held)
        yield _table(out, SESSION_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._held()
        past = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        gone = {k: s for k, s in held.items() if (s[5] + self.idle) // 1000 <= past}
        self._keep(None, {k: s for k, s in held.items() if k not in gone})
        yield _table([self._said(k, s[5], s[6], "expired", PHASES[s[0]], s) for k, s in gone.items()], SESSION_COLUMNS)

    def close(self) -> None:
        pass


SESSION_COLUMNS = [c.split()[0] for c in SESSION_EVENTS.split(", ")]


def _table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as objects, so that integers may be missing."""
    return pd.DataFrame(rows, columns=names, dtype=object)


def sessions(frames: DataFrame, idle: int = 30, most_symbols: int = MOST_SYMBOLS, groups: int = SESSION_GROUPS) -> DataFrame:
    """The events of sync sessions in a stream of frames received from peers.

    frames: peer, txid, ts, seq, kind (begin, symbols, need, records, end), n (symbols, ids or records of the frame),
    most_symbols and element_bytes (of a begin). A begin opens a session, in place of one that is still open, and may lower
    its budget of symbols. Refused, with the reason as detail: other element sizes, frames without an open session, symbols
    once records were asked for or beyond the budget, frames of too many ids or records, unknown kinds; the session stays as it is. Events:
    refused; ended, replaced and expired (no frame for `idle` seconds: ts is that of the last frame), with the phase as detail and the session's
    counts. An end without a session does nothing. Null times are dropped. A task holds the open sessions of one of `groups` groups at a time.
    """
    number = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    rows = frames.filter("ts is not null").withWatermark("ts", "0 seconds")
    rows = rows.select(
        F.pmod(F.xxhash64("peer", "txid"), F.lit(groups)).cast("int").alias("_group"), "peer", number("txid", "long"), F.col("txid").isNotNull().alias("has_txid"), F.unix_micros("ts").alias("at"), number("seq", "long"), F.col("seq").isNotNull().alias("has_seq"),
        "kind", number("n", "long"), number("most_symbols", "long"), number("element_bytes", "int"), "ts",
    )
    said = rows.groupBy("_group").transformWithStateInPandas(Sessions(idle, most_symbols), SESSION_EVENTS, "Append", "EventTime")
    return said.select("peer", "txid", F.timestamp_micros("at").alias("ts"), *SESSION_COLUMNS[3:])


BOOK_EVENTS = "node string, ts timestamp, seq long, peer string, action string, evicted string, successes long, failures long, n_new int, n_tried int"


class PeerBook(StatefulProcessor):
    """The new and the tried peers of one node, each a bounded map whose entries carry their place in the order of eviction."""

    def __init__(self, new_places: int, tried_places: int):
        self.places = {"new": new_places, "tried": tried_places}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peers = handle.getMapState("peers", "peer string", "tried boolean, place long, successes long, failures long")
        self.next = handle.getValueState("next", "place long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: tuple(v) for k, v in self.peers.iterator()} if self.peers.exists() else {}
        before = dict(held)
        (place,) = self.next.get() if self.next.exists() else (0,)
        tables: dict[str, dict[str, int]] = {"new": {}, "tried": {}}  # in the order of eviction
        for peer, (tried, at, *_) in sorted(held.items(), key=lambda x: x[1][1]):
            tables["tried" if tried else "new"][peer] = at

        def room(table: str) -> str | None:
            if len(tables[table]) < self.places[table]:
                return None
            out = next(iter(tables[table]))
            del tables[table][out], held[out]
            return out

        for r in _ordered(rows):
            e, evicted, action = held.get(r.peer), None, "ignored"
            place += 1
            if r.kind == "seen":
                action = "known"
                if e is None:
                    action, evicted = "added", room("new")
                    held[r.peer] = (False, place, 0, 0)
                    tables["new"][r.peer] = place
            elif r.kind == "answered" and e is not None:
                action = "refreshed" if e[0] else "promoted"
                del tables["tried" if e[0] else "new"][r.peer], held[r.peer]
                evicted = None if e[0] else room("tried")
                held[r.peer] = (True, place, e[2] + 1, e[3])
                tables["tried"][r.peer] = place
            elif r.kind == "failed" and e is not None:
                action = "failed"
                held[r.peer] = (*e[:3], e[3] + 1)
            elif r.kind == "closed" and e is not None:
                action = "removed"
                del tables["tried" if e[0] else "new"][r.peer], held[r.peer]
            now = held.get(r.peer) or (None, None, None, None)
            yield Row(node=key[0], ts=r.ts, seq=r.seq, peer=r.peer, action=action, evicted=evicted, successes=now[2], failures=now[3], n_new=len(tables["new"]), n_tried=len(tables["tried"]))
        for peer in before.keys() - held.keys():
            self.peers.removeKey((peer,))
        for peer, e in held.items():
            if before.get(peer) != e:
                self.peers.updateValue((peer,), e)
        self.next.update((place,))

    def close(self) -> None:
        pass


def peer_books(contacts: DataFrame, new_places: int = NEW_PLACES, tried_places: int = TRIED_PLACES) -> DataFrame:
    """What each contact does to the peer book of its node, in a stream of contacts(node, peer, ts, seq, kind).

    seen: an unknown peer becomes new. answered: a known one becomes, or stays, tried. failed: counted for known ones. closed: forgotten.
    Other kinds, and those of unknown peers, are ignored. A full table makes room: of the new the one
    first seen, of the tried the one longest without an answer. The rows tell the peer's counts and the sizes of both tables afterwards.
    """
    rows = contacts.select(F.col("node").cast("string").alias("node"), F.col("peer").cast("string").alias("peer"), "ts", "seq", "kind")
    return rows.groupBy("node").transformWithState(PeerBook(new_places, tried_places), BOOK_EVENTS, "Append", "None")


CACHE_EVENTS = "cache string, ts timestamp, seq long, id string, action string, evicted string, n_held int"


class RecordCache(StatefulProcessor):
    """The records of one cache: a bounded map from ids to their place in the queue; places of removed records stay in the queue until they come up.

    A batch asks the state once for each id and each old place that comes up, and writes back what has changed in the end.
    """

    def __init__(self, places: int):
        self.most = places

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id string", "t long")
        self.queue = handle.getMapState("queue", "place long", "id string")
        self.ends = handle.getValueState("ends", "head long, tail long, n int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head, tail, n = self.ends.get() if self.ends.exists() else (0, 0, 0)
        start, stop = head, tail
        before: dict[str, bool] = {}  # whether an id was held
        held: dict[str, tuple | None] = {}  # its value now, () for that of before, None if it isn't held
        new: dict[int, str] = {}  # places of this batch

        def holds(id: str) -> bool:
            if id not in before:
                before[id] = self.held.containsKey((id,))
                held[id] = () if before[id] else None
            return held[id] is not None

        for r in _ordered(rows):
            action, evicted = "ignored", None
            known = holds(r.id)
            if r.kind == "add":
                action = "repeated" if known else "added"
                if not known:
                    while n >= self.most > 0 and head < tail:
                        first = new.pop(head) if head >= stop else self.queue.getValue((head,))[0]
                        head += 1
                        if holds(first):
                            held[first], evicted, n = None, first, n - 1
                            break
                    new[tail] = r.id
                    tail, n = tail + 1, n + 1
                held[r.id] = (r.t or 0,)
            elif r.kind == "remove" and known:
                action, n, held[r.id] = "removed", n - 1, None
            yield Row(cache=key[0], ts=r.ts, seq=r.seq, id=r.id, action=action, evicted=evicted, n_held=n)
        for place in range(start, min(head, stop)):
            self.queue.removeKey((place,))
        for place, id in new.items():
            self.queue.updateValue((place,), (id,))
        for id, value in held.items():
            if value is None and before[id]:
                self.held.removeKey((id,))
            elif value:
                self.held.updateValue((id,), value)
        self.ends.update((head, tail, n))

    def close(self) -> None:
        pass


def record_caches(changes: DataFrame, places: int = CACHE_PLACES) -> DataFrame:
    """What each change does to its cache, in a stream of changes(cache, id, t, ts, seq, kind add or remove).

    A new record takes the last place of the queue; at capacity (0: none) the record of the first place that is still
    held goes. A known one keeps its place. A record that was removed and added again has two, of which the first
    counts. The rows tell the evicted id and the number of held records afterwards.
    """
    rows = changes.select(F.col("cache").cast("string").alias("cache"), F.col("id").cast("string").alias("id"), F.col("t").cast("long").alias("t"), "ts", "seq", "kind")
    return rows.groupBy("cache").transformWithState(RecordCache(places), CACHE_EVENTS, "Append", "None")
