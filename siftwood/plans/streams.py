"""Queries of streams with keyed state, fed in slices of time, each with its SQL: a fold over the rows of a key, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.session import table
from siftwood.streaming import feeds, keyed
from siftwood.streaming import state as streams

QUERIES: dict = {}
ORACLES: dict = {}
SLICES = 4


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events in slices of time; their times are stored without a zone, which watermarks need."""
    e = table(spark, d, "events")
    return feeds.time_slices(e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("user", F.col("user_id").cast("string")), "ts", SLICES)


_IDLE = 172_800  # seconds


@query("stream_sessions", f"""
with recursive f as (
  select user_id::varchar peer, event_id % 3 txid, ts, event_id seq, event_id % 1300 n, 500 + event_id % 2500 most, case when event_id % 13 = 0 then 16 else 32 end bytes,
    case when event_id % 11 < 2 then 'begin' when event_id % 11 < 6 then 'symbols' when event_id % 11 < 8 then 'need' when event_id % 11 < 10 then 'records' else 'end' end kind,
    row_number() over (partition by user_id, event_id % 3 order by ts, event_id) rn
  from events),
s(peer, txid, rn, phase, budget, symbols, records, refused, last, last_seq, old, said) as (
  select peer, txid, 0::bigint, -1, 0::bigint, 0::bigint, 0::bigint, 0::bigint, null::timestamp, null::bigint,
    null::struct(phase int, symbols bigint, records bigint, refused bigint, ts timestamp, seq bigint), null::struct(event varchar, detail varchar, symbols bigint, records bigint, refused bigint, ts timestamp, seq bigint)
  from f where rn = 1
  union all
  select peer, txid, rn,
    case when said.event = 'refused' then open when kind = 'begin' then 0 when kind = 'end' or open < 0 then -1 when kind = 'symbols' then 1 else 3 end,
    case when said.event = 'refused' or kind <> 'begin' then budget else least(most, 2000) end,
    case when said.event = 'refused' then symbols when kind = 'begin' then 0 when kind = 'symbols' then symbols + n else symbols end,
    case when said.event = 'refused' then records when kind = 'begin' then 0 when kind = 'records' then records + n else records end,
    case when said.event = 'refused' then refused + 1 when kind = 'begin' then 0 else refused end,
    ts, seq, old, said
  from (
    select *, case
      when kind = 'begin' and bytes <> 32 then {{event: 'refused', detail: 'element_size', symbols: null, records: null, refused: null, ts: ts, seq: seq}}
      when kind in ('symbols', 'need', 'records') and open < 0 then {{event: 'refused', detail: 'unknown_session', symbols: null, records: null, refused: null, ts: ts, seq: seq}}
      when kind = 'symbols' and open > 1 then {{event: 'refused', detail: 'phase', symbols: null, records: null, refused: null, ts: ts, seq: seq}}
      when kind = 'symbols' and symbols + n > budget then {{event: 'refused', detail: 'budget', symbols: null, records: null, refused: null, ts: ts, seq: seq}}
      when kind = 'need' and n > 1000 then {{event: 'refused', detail: 'too_many_ids', symbols: null, records: null, refused: null, ts: ts, seq: seq}}
      when kind = 'records' and n > 500 then {{event: 'refused', detail: 'too_many_records', symbols: null, records: null, refused: null, ts: ts, seq: seq}}
      when kind in ('begin', 'end') and open >= 0 then {{event: case kind when 'begin' then 'replaced' else 'ended' end, detail: ['begun', 'symbols', 'needed', 'fulfilled'][open + 1], symbols: symbols, records: records, refused: refused, ts: ts, seq: seq}}
      end said
    from (
      select f.*, s.budget, s.symbols, s.records, s.refused,
        case when s.phase >= 0 and f.ts >= s.last + interval {_IDLE} seconds then {{phase: s.phase, symbols: s.symbols, records: s.records, refused: s.refused, ts: s.last, seq: s.last_seq}} end old,
        case when s.phase >= 0 and f.ts >= s.last + interval {_IDLE} seconds then -1 else s.phase end open
      from s join f on f.peer = s.peer and f.txid = s.txid and f.rn = s.rn + 1))),
gone as (
  select peer, txid, old from s where old is not null
  union all
  select peer, txid, {{phase: phase, symbols: symbols, records: records, refused: refused, ts: last, seq: last_seq}} from s
  where phase >= 0 and last + interval {_IDLE} seconds <= (select max(ts) from events) qualify rn = max(rn) over (partition by peer, txid) and rn = (select max(f.rn) from f where f.peer = s.peer and f.txid = s.txid))
select peer, txid, said.ts, said.seq, said.event, said.detail, said.symbols, said.records, said.refused from s where said is not null
union all
select peer, txid, old.ts, old.seq, 'expired', ['begun', 'symbols', 'needed', 'fulfilled'][old.phase + 1], old.symbols, old.records, old.refused from gone""")
def stream_sessions(spark, d):
    """Every event is a frame of one of three sessions with its user."""
    e = F.col("event_id")
    kind = F.when(e % 11 < 2, "begin").when(e % 11 < 6, "symbols").when(e % 11 < 8, "need").when(e % 11 < 10, "records").otherwise("end")
    frames = _events(spark, d).select(F.col("user").alias("peer"), (e % 3).alias("txid"), "ts", e.alias("seq"), kind.alias("kind"), (e % 1300).alias("n"), (e % 2500 + 500).alias("most_symbols"), F.when(e % 13 == 0, 16).otherwise(32).alias("element_bytes"), "slice")
    return feeds.fed(frames, SLICES, lambda s: keyed.sessions(s, _IDLE))


@query("stream_peer_book", """
with recursive c as (
  select (user_id % 50)::varchar node, (event_id * 31 % 60)::varchar peer, ts, event_id seq,
    case when event_id % 10 = 0 then 'closed' when event_type in ('view', 'signup') then 'seen' when event_type in ('click', 'purchase') then 'answered' else 'failed' end kind,
    row_number() over (partition by user_id % 50 order by ts, event_id) rn
  from events),
s(node, rn, ts, seq, peer, fresh, tried, action, evicted, e) as (
  select node, 0::bigint, null::timestamp, null::bigint, null::varchar, []::struct(p varchar, s bigint, f bigint)[], []::struct(p varchar, s bigint, f bigint)[], null::varchar, null::varchar, null::struct(p varchar, s bigint, f bigint)
  from c where rn = 1
  union all
  select node, rn, ts, seq, peer,
    case action when 'added' then list_append(case when len(fresh) >= 12 then fresh[2:] else fresh end, e)
      when 'failed' then list_transform(fresh, lambda x: case when x.p = peer then e else x end)
      when 'promoted' then list_filter(fresh, lambda x: x.p <> peer) when 'removed' then list_filter(fresh, lambda x: x.p <> peer) else fresh end,
    case action when 'promoted' then list_append(case when len(tried) >= 6 then tried[2:] else tried end, e)
      when 'refreshed' then list_append(list_filter(tried, lambda x: x.p <> peer), e)
      when 'failed' then list_transform(tried, lambda x: case when x.p = peer then e else x end)
      when 'removed' then list_filter(tried, lambda x: x.p <> peer) else tried end,
    action,
    case when action = 'added' and len(fresh) >= 12 then fresh[1].p when action = 'promoted' and len(tried) >= 6 then tried[1].p end,
    case when action = 'removed' then null else e end
  from (
    select *, case when kind = 'seen' and known is null then {p: peer, s: 0, f: 0} when kind = 'answered' then {p: peer, s: known.s + 1, f: known.f} when kind = 'failed' then {p: peer, s: known.s, f: known.f + 1} else known end e,
      case when kind = 'seen' then case when known is null then 'added' else 'known' end when known is null then 'ignored'
        when kind = 'answered' then case when was then 'refreshed' else 'promoted' end when kind = 'failed' then 'failed' else 'removed' end action
    from (
      select c.*, s.fresh, s.tried, len(list_filter(s.tried, lambda x: x.p = c.peer)) > 0 was, list_filter(list_concat(s.fresh, s.tried), lambda x: x.p = c.peer)[1] known
      from s join c on c.node = s.node and c.rn = s.rn + 1)))
select node, ts, seq, peer, action, evicted, case when action <> 'ignored' then e.s end successes, case when action <> 'ignored' then e.f end failures, len(fresh)::int n_new, len(tried)::int n_tried from s where rn > 0""")
def stream_peer_book(spark, d):
    """Every event is a contact of one of fifty nodes with one of sixty peers; books have 12 and 6 places."""
    e, t = F.col("event_id"), F.col("event_type")
    kind = F.when(e % 10 == 0, "closed").when(t.isin("view", "signup"), "seen").when(t.isin("click", "purchase"), "answered").otherwise("failed")
    contacts = _events(spark, d).select((F.col("user_id") % 50).alias("node"), (e * 31 % 60).alias("peer"), "ts", e.alias("seq"), kind.alias("kind"), "slice")
    return feeds.fed(contacts, SLICES, lambda s: keyed.peer_books(s, 12, 6))


@query("stream_record_cache", """
with recursive c as (
  select (user_id % 50)::varchar cache, (event_id * 17 % 40)::varchar id, ts, event_id seq, case when event_id % 6 = 0 then 'remove' else 'add' end kind,
    row_number() over (partition by user_id % 50 order by ts, event_id) rn
  from events),
s(cache, rn, ts, seq, id, queue, held, action, evicted) as (
  select cache, 0::bigint, null::timestamp, null::bigint, null::varchar, []::varchar[], []::varchar[], null::varchar, null::varchar from c where rn = 1
  union all
  select cache, rn, ts, seq, id,
    case when action = 'added' then list_append(case when first is null then queue else queue[first + 1:] end, id) else queue end,
    case action when 'added' then list_append(list_filter(held, lambda x: first is null or x <> queue[first]), id) when 'removed' then list_filter(held, lambda x: x <> id) else held end,
    action, case when action = 'added' then queue[first] end
  from (
    select *, case when action = 'added' and len(held) >= 10 then list_position(list_transform(queue, lambda x: list_contains(held, x)), true) end first
    from (
      select c.*, s.queue, s.held, case when c.kind = 'add' then case when list_contains(s.held, c.id) then 'repeated' else 'added' end when list_contains(s.held, c.id) then 'removed' else 'ignored' end action
      from s join c on c.cache = s.cache and c.rn = s.rn + 1)))
select cache, ts, seq, id, action, evicted, len(held)::int n_held from s where rn > 0""")
def stream_record_cache(spark, d):
    """Every event adds a record to one of fifty caches of ten places, or removes one."""
    e = F.col("event_id")
    changes = _events(spark, d).select((F.col("user_id") % 50).alias("cache"), (e * 17 % 40).alias("id"), e.alias("t"), "ts", e.alias("seq"), F.when(e % 6 == 0, "remove").otherwise("add").alias("kind"), "slice")
    return feeds.fed(changes, SLICES, lambda s: keyed.record_caches(s, 10))


@query("stream_deadlines", """
with asked as (select event_id txid, user_id::varchar peer, ts from events where event_id % 2 = 0),
sent as (
  select event_id txid, user_id::varchar peer, ts + interval 1 second * (event_id % 5) said_at, event_id % 7 = 0 rejected from events where event_id % 2 = 0 and event_id % 3 > 0
  union all select event_id + 1, user_id::varchar, ts, false from events where event_id % 2 = 1 and event_id % 10 = 1)
select a.txid, a.peer, case when s.txid is null then 'timeout' when s.rejected then 'rejected' else 'answered' end outcome
from asked a left join sent s on s.txid = a.txid and s.peer = a.peer and s.said_at between a.ts and a.ts + interval 3 seconds""")
def stream_deadlines(spark, d):
    """Every second event asks its user; two in three are answered, some of them late, some by a reject; other answers are nobody's."""
    e = F.col("event_id")
    rows = _events(spark, d).select(e, "user", "ts", "slice")
    # The tick has to reach both watermarks. Filters of the result, and of null keys of a join, are pushed below these:
    # so it has keys, of nobody's peer, that don't meet, and is taken out behind the stream.
    tick = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("user"), (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.lit(SLICES).alias("slice"))

    peer = F.when(e.isNotNull(), F.col("user")).otherwise("").alias("peer")

    def plan(found):
        asked = found.filter((e % 2 == 0) | e.isNull()).select(F.coalesce(e, F.lit(-2)).alias("txid"), peer, F.col("ts").alias("asked_at"))
        own = found.filter((e % 2 == 0) & (e % 3 > 0) | e.isNull()).select(F.coalesce(e, F.lit(-1)).alias("txid"), peer, F.timestamp_micros(F.unix_micros("ts") + F.coalesce(e % 5, F.lit(0)) * 1_000_000).alias("answered_at"), (e % 7 == 0).alias("rejected"))
        stray = found.filter(e % 10 == 1).select((e + 1).alias("txid"), F.col("user").alias("peer"), F.col("ts").alias("answered_at"), F.lit(False).alias("rejected"))
        return streams.gathered_stream(asked, own.union(stray), 3).select("txid", "peer", "outcome")

    return feeds.fed(rows.union(tick), SLICES + 1, plan).filter("not peer <=> ''")  # the tick moves the watermark past the last deadline
