"""Queries of crawling, pointers, gossip, followed snapshots, state tables, lists and streams, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import bencode
from siftwood.functions import text as T
from siftwood.operators import crawl, documents, merge, peers, postings, records, sketches, snapshot, transfers, trust
from siftwood.session import spread, table, text_rows, work_dir
from siftwood.sources import extractors, tables
from siftwood.streaming import state as streams

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_list = ", ".join(f"'{w}'" for w in T.KEYWORD_STOP_WORDS + T.EXTENSION_WORDS)
KEYWORDS = rf"""list_filter(regexp_split_to_array(lower(coalesce({{0}}, '')), '[^\p{{{{L}}}}\p{{{{Nd}}}}]+'), lambda w: strlen(w) >= 3 and w not in ({_list}))"""


def _sha(prefix: str, column: str, kind=F.sha1):
    return kind(F.concat(F.lit(prefix), F.col(column).cast("string")).cast("binary"))


def _key(prefix: str, column: str):
    return F.sha2(F.concat(F.lit(prefix), F.col(column).cast("string")).cast("binary"), 256)


# Crawling.


def _crawled(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a sample. By its key's remainder by 5 its metainfo is signed, badly signed, unsigned, no bencode, or can't be fetched."""
    import pandas as pd

    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), _sha("p", "p_partkey").alias("infohash"))

    def make(frames):
        for f in frames:
            keys, infos = f.k.tolist(), [bencode.encode({"length": k + 1, "name": f"n{k}"}) for k in f.k.tolist()]
            raw = [{2: b"d4:info" + info + b"e", 3: b"d4:info"}.get(k % 5) for k, info in zip(keys, infos, strict=True)]
            for s in range(3):
                own = [i for i, k in enumerate(keys) if k % 5 < 2 and k % 3 == s]
                for i, good in zip(own, crawl.signed_metainfos([infos[i] for i in own], bytes([s + 1]) * 32), strict=True):
                    raw[i] = good.replace(b"4:name", b"4:nome") if keys[i] % 5 else good
            yield pd.DataFrame({"infohash": f.infohash, "raw": raw})

    fetched = spread(rows).mapInPandas(make, "infohash string, raw binary").filter("raw is not null")
    return crawl.crawled(rows, fetched)


@query("crawl_classes", "select p_partkey k, ['forwarded', 'bad_signature', 'unsigned', 'malformed', 'fetch_error'][p_partkey % 5 + 1] as class, p_partkey % 5 < 2 has_publisher from part")
def crawl_classes(spark, d):
    return _crawled(spark, d).select("k", "class", F.col("publisher").isNotNull().alias("has_publisher"))


@query("crawl_outcomes", "select count(*) filter (where k = 0) forwarded, count(*) filter (where k = 1) bad_signature, count(*) filter (where k = 2) unsigned, count(*) filter (where k = 3) malformed, count(*) filter (where k = 4) fetch_error from (select p_partkey % 5 k from part)")
def crawl_outcomes(spark, d):
    return crawl.outcomes(_crawled(spark, d))


@query("crawl_publishers", "select count(*) filter (where p_partkey % 5 = 0) valid, count(*) filter (where p_partkey % 5 = 1) bad from part where p_partkey % 5 < 2 group by p_partkey % 3")
def crawl_publishers(spark, d):
    return crawl.observed(_crawled(spark, d)).select("valid", "bad")


@query("sample_infohashes", "select o_custkey node, sha1('o' || o_orderkey) infohash, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int place from orders")
def sample_infohashes(spark, d):
    ids = F.array_sort(F.collect_list(F.struct("o_orderkey", F.unhex(_sha("o", "o_orderkey")).alias("ih"))))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.unhex(F.array_join(F.transform(ids, lambda x: F.hex(x.ih)), "")).alias("samples"), F.lit(60).alias("interval"), F.count("*").alias("num"))
    return crawl.sampled(rows).select("node", "infohash", "place")


@query("gossip_endorsements", """
with a as (select o_custkey c, min(o_orderkey) seq from orders group by 1),
e as (select o_custkey c, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) r, l_suppkey s from (select o_custkey, o_orderkey, min(l_suppkey) l_suppkey from orders join lineitem on l_orderkey = o_orderkey group by 1, 2))
select distinct sha256('k' || c) endorser, sha256('k' || s) candidate from e where r <= 10 and c % 4 <> 0 and s % 7 <> 0 and s <> c""")
def gossip_endorsements(spark, d):
    """A customer announces once and endorses the first supplier of each of its orders; some keys are missing or of a wrong length."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    rows = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    key = lambda c, bad: F.when(bad, F.lit(bytes(32))).otherwise(F.unhex(_key("k", c)))
    candidate = F.struct("o_orderkey", F.when(F.col("s") % 14 == 0, F.lit(b"short")).otherwise(key("s", F.col("s") % 7 == 0)).alias("k"))
    said = F.transform(F.array_sort(F.collect_list(candidate)), lambda x: x.k)
    announces = rows.groupBy("o_custkey").agg(said.alias("endorsed"), F.min("o_orderkey").alias("seq"))
    announces = announces.select(F.col("o_custkey").cast("string").alias("peer"), "seq", key("o_custkey", F.col("o_custkey") % 4 == 0).alias("pubkey"), "endorsed")
    return crawl.gossip(announces)[1]


@query("gossip_indexers", "select sha256('k' || c_custkey) publisher, 'gossip:' || c_custkey as label from customer where c_custkey % 4 <> 0")
def gossip_indexers(spark, d):
    c = F.col("c_custkey")
    announces = table(spark, d, "customer").select(c.cast("string").alias("peer"), F.lit(1).alias("seq"), F.when(c % 4 == 0, F.lit(b"x")).otherwise(F.unhex(_key("k", "c_custkey"))).alias("pubkey"), F.lit(None).cast("array<binary>").alias("endorsed"))
    return crawl.gossip(announces)[0]


@query("auto_confirm", "select sha1('p' || p_partkey) infohash from part where p_partkey % 7 = 0 or p_size > 40 or lower(p_brand) = 'brand#2'")
def auto_confirm(spark, d):
    p = table(spark, d, "part").select(_sha("p", "p_partkey").alias("infohash"), "p_partkey", (F.col("p_size") > 40).alias("complete"), F.col("p_brand").alias("signed_by"))
    known = p.filter("p_partkey % 7 = 0")
    return crawl.confirmed(known, p, spark.createDataFrame([("BRAND#2",)], "publisher string"))


# Pointers.

POINTERS = """p as (select s_suppkey k, case when s_suppkey % 5 = 4 then 19 else 20 end ih_n, case when s_suppkey % 3 = 0 then 32 when s_suppkey % 3 = 1 then 0 else 32 - (s_suppkey % 2) end commit_n,
  case when s_suppkey % 4 = 0 then 32 else 0 end topics_n, case when s_suppkey % 6 = 0 then 0 else s_suppkey * 1000 end ts from supplier)"""


def _pointers(spark, d):
    s, long = F.col("s_suppkey"), F.unhex(_key("c", "s_suppkey"))
    commit = F.when(s % 3 == 0, long).when(s % 3 == 1, F.lit(b"")).when(s % 2 == 0, long).otherwise(F.substring(long, F.lit(1), F.lit(31)))
    ih = F.unhex(_sha("s", "s_suppkey"))
    return table(spark, d, "supplier").select(s.alias("publisher"), F.when(s % 5 == 4, F.substring(ih, F.lit(1), F.lit(19))).otherwise(ih).alias("ih"), commit.alias("commit"), F.when(s % 4 == 0, long).alias("topics"), F.lit(None).cast("binary").alias("next_pk"), F.when(s % 6 == 0, 0).otherwise(s * 1000).cast("long").alias("ts"))


@query("index_pointers", f"""
with {POINTERS} select k publisher, (case when ts = 0 then 1700000000 else ts end)::bigint ts,
  (2 + 4 + 23 + case when commit_n > 0 then 8 + 35 else 0 end + case when topics_n > 0 then 8 + 35 else 0 end + 4 + 2 + length((case when ts = 0 then 1700000000 else ts end)::varchar))::bigint bytes
from p where ih_n = 20 and commit_n in (0, 32)""")
def index_pointers(spark, d):
    return postings.pointers(_pointers(spark, d), 1_700_000_000).select("publisher", "ts", "bytes")


@query("pointer_lookup", f"with {POINTERS} select k publisher, sha1('s' || k) ih from p where ih_n = 20 and commit_n in (0, 32) and k % 2 = 0")
def pointer_lookup(spark, d):
    """Pointers are put under the index salt, some twice, and looked up by publisher."""
    rows = postings.pointers(_pointers(spark, d), 1_700_000_000).select(F.col("publisher").alias("pk"), F.lit(postings.INDEX_SALT).alias("salt"), F.col("ih").alias("value"))
    store = postings.put(postings.put(rows.withColumn("seq", F.lit(0).cast("long")).filter("false"), rows.withColumn("value", F.lit(b"old"))), rows)
    asked = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("pk"), F.lit(postings.INDEX_SALT).alias("salt"))
    return postings.get(store, asked).select(F.col("pk").alias("publisher"), F.lower(F.hex("value")).alias("ih"))


# Snapshots and the index.


def _nested(spark, d):
    c = table(spark, d, "conversations")
    parents = c.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", _sha("c", "conv_id").alias("infohash"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("name"), F.col("n").alias("size"), F.lit(0).cast("long").alias("added_at"), F.array(F.lit("user"), F.lit("assistant")).alias("file_paths"))
    content = c.select(_sha("c", "conv_id").alias("infohash"), F.when(F.col("role") == "user", 0).otherwise(1).alias("file_index"), F.lit(1).cast("long").alias("file_size"), F.lit("text/plain").alias("mime"), F.lit("plaintext").alias("extractor"), F.col("turn").cast("int").alias("chunk_index"), "text", F.lit(0).cast("long").alias("offset"))
    return parents, snapshot.nested(parents, content)


CHUNKS = "chunks as (select conv_id, case role when 'user' then 0 else 1 end file_index, (row_number() over (partition by conv_id, role = 'user' order by turn) - 1)::int chunk_index, text from conversations)"


@query("snapshot_round_trip", f"with {CHUNKS} select sha1('c' || conv_id) infohash, file_index, chunk_index, text from chunks")
def snapshot_round_trip(spark, d):
    """A snapshot is written as gzip JSON lines, found by its name and read back."""
    folder = work_dir(spark)
    snapshot.write_snapshot(_nested(spark, d)[1], crawl.fetched_path(folder, "index"), "publisher", 1)
    return snapshot.flattened(crawl.fetched(spark, folder, "index")).select("infohash", "file_index", "chunk_index", "text")


@query("snapshot_document", "select count(distinct conv_id) torrents, sum((role = 'user')::int)::bigint user_chunks from conversations")
def snapshot_document(spark, d):
    one = snapshot.to_document(_nested(spark, d)[1], "p", 1)
    parsed = one.select(F.from_json("document", f"struct<version:int,format:string,torrents:array<{snapshot.TORRENT}>>").alias("d"))
    files = parsed.select(F.explode("d.torrents").alias("t")).select(F.col("t.infohash").alias("infohash"), F.explode("t.files").alias("f"))
    return files.agg(F.count_distinct("infohash").alias("torrents"), F.sum(F.when(F.col("f.path") == "user", F.size("f.chunks")).otherwise(0)).alias("user_chunks"))


def _round(spark, d):
    parents, rows = _nested(spark, d)
    payloads = rows.join(parents.select("infohash", "conv_id"), "infohash").withColumn("snapshot", F.col("conv_id") % 10).drop("conv_id")
    followed = spark.range(12).select(F.col("id").alias("publisher"))
    pointers = spark.range(11).select(F.col("id").alias("publisher"), F.when(F.col("id") == 10, 99).otherwise(F.col("id")).alias("snapshot"))
    local = spark.createDataFrame([], documents.CHUNKS)
    return crawl.round_of(followed, pointers, payloads, local, F.lit("2024-01-01").cast("timestamp"))


@query("subscriber_results", "select publisher, case when publisher = 11 then 'no_pointer' when n > 0 then 'synced' else 'no_payload' end state, n torrents, c chunks from (select r.range publisher, count(distinct conv_id) n, count(conv_id) c from range(12) r left join conversations on conv_id % 10 = r.range and r.range < 10 group by 1)")
def subscriber_results(spark, d):
    return _round(spark, d)[1]


@query("subscriber_chunks", f"with {CHUNKS} select sha1('c' || conv_id) infohash, file_index, chunk_index, text from chunks where text <> ''")
def subscriber_chunks(spark, d):
    return _round(spark, d)[0].select("infohash", "file_index", "chunk_index", "text")


@query("snapshot_due", "select user_id publisher from (select user_id, max(event_id) last, max(case when event_type = 'view' then event_id end) seen from events group by 1) where seen is null or last > seen")
def snapshot_due(spark, d):
    e = table(spark, d, "events")
    followed = e.groupBy(F.col("user_id").alias("publisher")).agg(F.max("event_id").alias("generated_at"))
    done = e.filter("event_type = 'view'").select(F.col("user_id").alias("publisher"), F.col("event_id").alias("generated_at"))
    return snapshot.newer(followed, done).select("publisher")


@query("refresh_throttle", "select user_id publisher from events group by 1 having max(ts) <= timestamp '2024-01-29 23:59:00'")
def refresh_throttle(spark, d):
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("keyword")).agg(F.max("ts").alias("last_published"))
    return postings.due(last, F.lit("2024-01-30 00:00:00").cast("timestamp"), 1).select(F.col("keyword").alias("publisher"))


def _parents(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("AA"), F.col("p_partkey").cast("string")).alias("infohash"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("file_paths"), F.lit(None).cast("array<string>").alias("trackers"), F.col("p_size").cast("bigint").alias("size_bytes"), F.lit(0).alias("file_count"), F.lit(None).cast("timestamp").alias("added_at"), F.col("p_brand").alias("signed_by"))


def _stored(spark, d):
    """Parents and chunks after upserts, written as an index and opened again."""
    now = F.lit("2024-01-01").cast("timestamp")
    new = _parents(spark, d)
    parents = documents.upsert_parents(documents.upsert_parents(spark.createDataFrame([], documents.PARENTS), new, now), new.filter("size_bytes > 25").withColumn("name", F.lit("newer")), now)
    docs = table(spark, d, "documents")
    chunk = docs.select(F.concat(F.lit("AA"), (F.col("doc_id") % 500).cast("string")).alias("infohash"), (F.col("doc_id") / 500).cast("int").alias("file_index"), F.lit("f").alias("file_path"), F.col("n_chars").alias("file_size"), F.lit("text/plain").alias("mime"), "text", F.lit("plaintext").alias("extractor"), now.alias("indexed_at"), F.lit(0).alias("chunk_index"))
    chunks = documents.upsert_chunks(documents.upsert_chunks(spark.createDataFrame([], documents.CHUNKS), chunk), chunk.filter("file_size > 2000").withColumn("text", F.lit("newer")))
    path = work_dir(spark)
    documents.write_index(documents.mixed(parents, chunks), path)
    return documents.open_index(spark, path, documents.PARENTS)


@query("upsert_parents", "select 'aa' || p_partkey as infohash, case when p_size > 25 then 'newer' else p_name end as name, 2 file_count, lower(p_brand) signed_by from part")
def upsert_parents(spark, d):
    return _stored(spark, d).filter("doc_type = 'torrent'").select("infohash", "name", "file_count", "signed_by")


@query("upsert_chunks", "select 'aa' || (doc_id % 500) as infohash, (doc_id // 500)::int file_index, case when n_chars > 2000 then 'newer' else text end as text from documents where text <> ''")
def upsert_chunks(spark, d):
    return _stored(spark, d).filter("doc_type = 'content'").select("infohash", "file_index", "text")


@query("chunks_of_parent", "select (doc_id // 500)::int file_index, n_chars file_size from documents where doc_id % 500 = 7 and text <> ''")
def chunks_of_parent(spark, d):
    return documents.chunks_of(_stored(spark, d).filter("doc_type = 'content'"), "AA7").select("file_index", "file_size")


@query("pagination", "select infohash from (select 'aa' || p_partkey infohash from part) order by 1 limit 1000 offset 100")
def pagination(spark, d):
    rows = _stored(spark, d).filter("doc_type = 'torrent'").select("infohash")
    return documents.page_of(rows, [F.col("infohash")], 100, 1000)


# Lists and state tables.


@query("trust_list", "select distinct lower(p_brand) publisher from part")
def trust_list(spark, d):
    return trust.listed(table(spark, d, "part").select(F.lower("p_brand").alias("publisher")).distinct())


@query("manifest_list", "select distinct p_name keyword from part")
def manifest_list(spark, d):
    return postings.manifest_keywords(table(spark, d, "part").select(F.col("p_name").alias("keyword")))


_SORTS = {"name": ("name", False), "status": ("status", True), "progress": ("progress", False), "size": ("size", True), "peers": ("peers", False), "down_rate": ("down_rate", True), "up_rate": ("up_rate", False), "indexing": ("indexing", False), "signed_by": ("signed_by", False)}
SNAPS = """t as (select o_orderkey id, o_orderpriority as name, o_orderstatus status, (o_orderkey % 11) / 10.0::double progress, o_totalprice size, o_custkey % 9 peers, o_orderkey % 13 down_rate, o_orderkey % 5 up_rate, o_orderkey % 2 = 0 indexing, case when o_orderkey % 3 = 0 then o_orderpriority else '' end signed_by from orders)"""


def _sorted_sql() -> str:
    keys = {"name": "name", "status": "status desc", "progress": "progress", "size": "size desc", "peers": "peers", "down_rate": "down_rate desc", "up_rate": "up_rate", "indexing": "indexing, name", "signed_by": "signed_by = '', signed_by"}
    parts = [f"select '{c}' sorted_by, id, row_number() over (order by {k}, id) place from t" for c, k in keys.items()]
    return f"with {SNAPS} select sorted_by, id, place from ({' union all '.join(parts)}) where place <= 25"


@query("transfer_columns", _sorted_sql())
def transfer_columns(spark, d):
    """The first rows of the transfer list by each of its nine columns."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"), ((k % 11) / F.lit(10.0)).alias("progress"), F.col("o_totalprice").alias("size"), (F.col("o_custkey") % 9).alias("peers"), (k % 13).alias("down_rate"), (k % 5).alias("up_rate"), (k % 2 == 0).alias("indexing"), F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("signed_by"))
    out = None
    for name, (column, desc) in _SORTS.items():
        top = transfers.sorted_by(rows, column, desc, "id").limit(25)
        ordered = top.agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("r")) if "place" in top.columns else transfers.numbered(top, column, desc, "id")
        ordered = ordered.select(F.lit(name).alias("sorted_by"), "id", "place")
        out = ordered if out is None else out.unionByName(ordered)
    return out


@query("status_of_state", """
with r as (select user_id u, count(*) n, max(event_type = 'purchase') ok from events group by 1)
select (select count(*) from r) known_peers, (select count(*) from r where ok) capable_peers, (select count(*) from supplier) indexers, (select count(*) from supplier where s_suppkey < 3) anchors,
  (select count(*) from supplier where s_suppkey % 2 = 0) admitted, (select count(*) from supplier where s_suppkey % 2 = 1) pending, least((select count(*) from part), 100000) cached_records""")
def status_of_state(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("services"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("publisher"))
    admitted = s.filter("publisher % 2 = 0").select("publisher", F.when(F.col("publisher") < 3, "anchor").otherwise("policy").alias("reason"))
    anchors = s.filter("publisher < 3")
    return peers.state_rollup(e, s, anchors, admitted, s, table(spark, d, "part"), 100_000)


@query("state_tables", "select user_id publisher, count(*) n from events where event_type <> 'error' group by 1")
def state_tables(spark, d):
    """A state table is written as JSON and read with its checks: rows without a key are dropped."""
    rows = table(spark, d, "events").groupBy(F.when(F.col("event_type") != "error", F.col("user_id")).alias("publisher")).agg(F.count("*").alias("n"))
    path = work_dir(spark)
    tables.write_state(rows, path)
    return tables.read_state(spark, path, "publisher long, n long", ["publisher"])


@query("record_lines", "select sha1('p' || p_partkey) ih, p_name kw, p_size::bigint t from part")
def record_lines(spark, d):
    path = work_dir(spark)
    rows = table(spark, d, "part").select(_sha("p", "p_partkey").alias("ih"), F.col("p_name").alias("kw"), F.col("p_size").cast("long").alias("t"))
    rows.select(F.to_json(F.struct("ih", "kw", "t")).alias("value")).write.text(path)
    return tables.read_record_lines(spark, path).select(F.lower(F.hex("ih")).alias("ih"), "kw", "t")


@query("lookup_counts", "select (select count(*) from customer) asked, count(*) filter (where o_orderkey % 4 > 0) responded, coalesce(sum(o_orderkey % 10) filter (where o_orderkey % 4 > 0), 0)::bigint returned from orders")
def lookup_counts(spark, d):
    o = F.col("o_orderkey")
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("publisher"), (o % 4 == 0).alias("failed"), (o % 10).alias("n_hits"))
    out = merge.lookup_counts(table(spark, d, "customer").select(F.col("c_custkey").alias("publisher")), first)
    asked = table(spark, d, "customer").agg(F.count("*").alias("asked"))
    return out.drop("asked").join(asked).select("asked", "responded", F.col("returned").cast("long").alias("returned"))


@query("unresolved_indexers", "select s_suppkey publisher from supplier where s_suppkey % 5 = 4 or (s_suppkey % 3 = 2 and s_suppkey % 2 = 1)")
def unresolved_indexers(spark, d):
    found = postings.pointers(_pointers(spark, d), 1).select("publisher")
    return merge.unresolved(table(spark, d, "supplier").select(F.col("s_suppkey").alias("publisher")), found)


@query("wire_filters", "select sha1('p' || p_partkey) infohash from part where p_type = 'ECONOMY' and p_size between 5 and 30 and p_partkey % 9 <> 0")
def wire_filters(spark, d):
    rows = table(spark, d, "part").select(_sha("p", "p_partkey").alias("infohash"), F.col("p_type").alias("lang"), F.col("p_size").alias("size"), "p_partkey")
    return merge.wire_filters(rows, "ECONOMY", 5, 30, rows.filter("p_partkey % 9 = 0")).select("infohash")


@query("merged_anchors", "select distinct sha256('k' || k) publisher from (select s_suppkey k from supplier where s_suppkey % 2 = 0 union all select c_custkey from customer where c_custkey % 3 = 0)")
def merged_anchors(spark, d):
    own = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.upper(_key("k", "s_suppkey")).alias("publisher"))
    other = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, _key("k", "c_custkey")).otherwise("bad").alias("publisher"))
    return trust.merged_anchors(own, other)


@query("seed_import", "select sha256('k' || s_suppkey) publisher, true good from supplier where s_suppkey % 4 <> 0 union all select 'short' || s_suppkey, false from supplier where s_suppkey % 4 = 0")
def seed_import(spark, d):
    s = F.col("s_suppkey")
    good, bad = trust.seed_import(table(spark, d, "supplier").select(F.when(s % 4 == 0, F.concat(F.lit("short"), s.cast("string"))).otherwise(F.upper(_key("k", "s_suppkey"))).alias("publisher")), 1)
    return good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))


@query("piece_hashes", "with f as (select page_id, encode(html) c, strlen(html) n from pages), p as (select page_id, unnest(range(0, greatest(1, (n + 1023) // 1024))) piece, c from f) select page_id, count(*) pieces from p group by 1")
def piece_hashes(spark, d):
    """Every piece of a page, checked against the bytes that it stands for."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    hashed = tables.file_pieces(pages, 1024).join(pages, "path")
    right = F.sha1(F.substring(F.col("content"), F.col("piece") * 1024 + 1, F.lit(1024))) == F.col("sha1")
    return hashed.filter(right).groupBy(F.col("path").alias("page_id")).agg(F.count("*").alias("pieces"))


@query("folder_files", "select count(*) files, sum(strlen(html))::bigint bytes from pages")
def folder_files(spark, d):
    """Pages are written as files of a folder, whose number and size are found without reading them."""
    folder = work_dir(spark).removeprefix("file://")
    pages = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))

    def write(frames):
        from pyarrow import fs

        for f in frames:
            for i, text in zip(f.page_id, f.html, strict=True):
                system, path = fs.FileSystem.from_uri(f"file://{folder}" if folder.startswith("/") else folder)
                system.create_dir(path, recursive=True)
                with system.open_output_stream(f"{path}/{i}.html", compression=None) as out:
                    out.write(text.encode())
            yield f[["page_id"]]

    pages.mapInPandas(write, "page_id long").count()
    return extractors.folder_bytes(spark, f"file://{folder}" if folder.startswith("/") else folder)


@query("name_checks", "select c_custkey k, c_custkey % 2 = 0 infohash, c_custkey % 3 = 0 public_key, case when c_custkey % 5 = 0 then null else 'kw' || c_custkey || '#2' end salt from customer")
def name_checks(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, F.upper(_sha("c", "c_custkey"))).otherwise("zz").alias("ih"), F.when(k % 3 == 0, _key("c", "c_custkey")).otherwise(_sha("c", "c_custkey")).alias("pk"), F.when(k % 5 == 0, F.repeat(F.lit("x"), 65)).otherwise(F.concat(F.lit("kw"), k.cast("string"))).alias("kw"))
    return rows.select(k.alias("k"), T.is_infohash(F.col("ih")).alias("infohash"), T.is_public_key(F.col("pk")).alias("public_key"), T.keyword_salt(F.col("kw"), 2).alias("salt"))


@query("records_fingerprint", "select sum(n)::bigint records, true same_as_one_file from (select 1 n from benchmark)")
def records_fingerprint(spark, d):
    """Digests of ranges of the sorted records, against the digest of one file of all of them."""
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("kw"), F.unhex(_sha("", "item_id")).alias("ih"), F.col("item_id").alias("t"))
    made = records.signed(rows, bytes(range(32)))
    path = work_dir(spark)
    made.write.parquet(path)
    made = spark.read.parquet(path)
    found = records.range_fingerprints(made)
    whole = records.fingerprint(made)
    return found.agg(F.sum("n").alias("records"), F.lit(records.fingerprint_of_file(made) == whole).alias("same_as_one_file"))


@query("http_limit", "select event_id, case when floor(value)::int - 20 <= 0 then 50 when (floor(value)::int - 20) * 10 > 500 then 500 else (floor(value)::int - 20) * 10 end as most from events")
def http_limit(spark, d):
    asked = (F.floor("value").cast("int") - 20) * 10
    return table(spark, d, "events").select("event_id", merge.http_limit(asked).alias("most"))


@query("admission_counts", "select count(*) filter (where s_suppkey < 3) anchors, count(*) filter (where s_suppkey % 2 = 0) admitted, (select count(*) from (select l_suppkey from lineitem union select s_suppkey from supplier) where l_suppkey % 2 = 1) pending from supplier")
def admission_counts(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("publisher"))
    admitted = s.filter("publisher % 2 = 0")
    waiting = trust.pending(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("candidate")), s, admitted)
    return trust.admission_counts(s.filter("publisher < 3"), admitted, waiting)


@query("transfer_facts", "with c as (select user_id, count(*) filter (where event_type in ('view', 'click')) n from events group by 1) select p_partkey id, lower(p_brand) in ('brand#2', 'brand#3') trusted_publisher, coalesce(n, 0)::bigint indexed_files from part left join c on user_id = p_partkey")
def transfer_facts(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("infohash"), F.col("p_brand").alias("signed_by"))
    kind = F.when(F.col("event_type").isin("view", "click"), "extracted").otherwise("skipped")
    counters = transfers.outcome_counts(table(spark, d, "events").select(F.col("user_id").alias("infohash"), kind.alias("outcome")))
    return transfers.with_facts(rows, spark.createDataFrame([("Brand#2",), ("BRAND#3",)], "publisher string"), counters).select(F.col("infohash").alias("id"), "trusted_publisher", "indexed_files")


@query("sync_session", "select 'asked' kind, count(*) n, true in_bound from orders where o_orderkey % 10 > 6 union all select 'answered', count(*), true from orders where o_orderkey % 10 > 6")
def sync_session(spark, d):
    """What one side lacks is asked for and answered in messages of bounded size."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    asked, answered = sketches.session(ids.filter("id % 10 < 7"), ids.filter("id % 10 > 2"), table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"))
    out = None
    for kind, rows, most in (("asked", asked, sketches.IDS_SENT), ("answered", answered, sketches.RECORDS_SENT)):
        one = rows.groupBy("message").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), (F.max("c") <= most).alias("in_bound")).select(F.lit(kind).alias("kind"), "n", "in_bound")
        out = one if out is None else out.union(one)
    return out


@query("metainfo_pieces", """
with h as (select string_agg(hex(encode(html)), '' order by '/' || page_id) x from pages), p as (select unnest(range(0, (length(x) // 2 + 4095) // 4096)) piece, x from h)
select piece, sha1(unhex(substr(x, piece * 8192 + 1, 8192))) sha1 from p""")
def metainfo_pieces(spark, d):
    """Pages as one torrent: pieces go over the bounds of files."""
    files = table(spark, d, "pages").select(F.concat(F.lit("/"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    return tables.metainfo_pieces(files, 4096)


@query("minted_records", f"select kw, count(*) n from (select unnest(list_distinct({KEYWORDS.format('p_name')})) kw from part) group by 1")
def minted_records(spark, d):
    """A signed record of each keyword of each part's name."""
    names = table(spark, d, "part").select(_sha("p", "p_partkey").alias("infohash"), F.col("p_name").alias("name"))
    return records.well_formed(records.minted(names, bytes(range(32)), 7)).filter("t = 7 and pow = 0").groupBy("kw").agg(F.count("*").alias("n"))


# Streams, each run to the end of its input.


def _run_stream(spark, out: DataFrame) -> DataFrame:
    folder = work_dir(spark)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _event_stream(spark, d):
    """The events as a stream of files; their times are stored without a zone, which watermarks need."""
    rows, folder = table(spark, d, "events"), work_dir(spark)
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


@query("stream_completed", "with a as (select distinct user_id u, event_id % 7 p from events) select 'u' || u as infohash, 0 file_index from a group by u having count(*) = 7")
def stream_completed(spark, d):
    e = _event_stream(spark, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("infohash"), F.lit(0).alias("file_index"), (F.col("event_id") % 7).alias("piece"), F.lit(7).alias("needed"))
    return _run_stream(spark, streams.completed_stream(e))


_BUCKET = """
with l as (select user_id, list({t: epoch(ts), k: 3.0::double, f: []::boolean[], w: ts} order by ts) e from events group by 1),
r as (select user_id, e, list_reduce(list_prepend({t: e[1].t, k: 3.0::double, f: []::boolean[], w: e[1].w}, e), lambda a, x:
  {t: x.t, k: least(3.0, a.k + (x.t - a.t) * 0.0005) - case when least(3.0, a.k + (x.t - a.t) * 0.0005) >= 1 - 1e-9 then 1 else 0 end,
   f: list_append(a.f, least(3.0, a.k + (x.t - a.t) * 0.0005) >= 1 - 1e-9), w: x.w}) s from l)
select user_id::varchar peer, unnest(list_transform(e, lambda x: x.w)) ts, unnest(s.f) allowed from r"""


@query("stream_limited", _BUCKET)
def stream_limited(spark, d):
    e = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("peer"), "ts")
    return _run_stream(spark, streams.limited_stream(e, 0.0005, 3.0))


ORACLES["token_bucket"] = _BUCKET
ORACLES["bans_with_expiry"] = """
with c as (select user_id, ts, case event_type when 'error' then 20 when 'click' then 5 else 0 end p from events),
l as (select user_id, list({t: ts, p: p, s: 0, u: null::timestamp, f: []::struct(score int, banned boolean)[]} order by ts) e from c group by 1),
r as (select user_id, e, list_reduce(list_prepend({t: e[1].t, p: 0, s: 0, u: null::timestamp, f: []::struct(score int, banned boolean)[]}, e), lambda a, x: {t: x.t, p: 0,
  s: case when a.u is not null and x.t >= a.u then 0 else a.s end + x.p,
  u: case when a.u is not null and x.t < a.u then a.u when case when a.u is not null and x.t >= a.u then 0 else a.s end + x.p >= 100 then x.t + interval 24 hours else null::timestamp end,
  f: list_append(a.f, {score: case when a.u is not null and x.t >= a.u then 0 else a.s end + x.p, banned: (a.u is not null and x.t < a.u) or case when a.u is not null and x.t >= a.u then 0 else a.s end + x.p >= 100})}) s from l)
select user_id::varchar peer, unnest(list_transform(e, lambda x: x.t)) ts, unnest(list_transform(s.f, lambda x: x.score))::bigint score, unnest(list_transform(s.f, lambda x: x.banned)) banned from r"""


@query("stream_fresh", "select distinct user_id id from events")
def stream_fresh(spark, d):
    """Records of an id count once while the id is remembered; here it always is."""
    e = _event_stream(spark, d).select(F.col("user_id").alias("id"), "ts")
    return _run_stream(spark, streams.fresh_records(e, "3650 days")).select("id")


@query("stream_windows", "select w start, event_type, count(*) n from (select time_bucket(interval 1 hour, ts) w, event_type from events) where w + interval 1 hour <= (select max(ts) - interval 10 minutes from events) group by 1, 2")
def stream_windows(spark, d):
    """Windows that the watermark has passed."""
    return _run_stream(spark, streams.windowed_counts(_event_stream(spark, d))).select("start", "event_type", "n")


@query("stream_answers", "select event_id txid from events where event_id % 3 > 0")
def stream_answers(spark, d):
    """Answers of a third of the queries come too late."""
    e = _event_stream(spark, d)
    asked = e.select(F.col("event_id").alias("txid"), F.col("ts").alias("asked_at"))
    answered = _event_stream(spark, d).select(F.col("event_id").alias("txid"), (F.col("ts") + F.when(F.col("event_id") % 3 == 0, F.expr("interval 5 seconds")).otherwise(F.expr("interval 2 seconds"))).alias("answered_at"))
    return _run_stream(spark, streams.answered_stream(asked, answered)).select("txid")


@query("chunk_places", "select doc_id, true in_place, true within_bound, true whole from documents where regexp_replace(text, '[ \\t-\\r]+', '', 'g') <> ''")
def chunk_places(spark, d):
    """Chunks stand at their offsets, are of bounded size, and hold all that isn't white space."""

    text_rows(spark)
    white = re.compile(rb"\s*")

    def check(text):
        data, parts = text.encode(), T.chunks(text)
        squeezed = lambda s: "".join(s.split())
        first = lambda s: s.split("\n\n")[0].split("\n")[0].encode()
        behind = lambda o: white.match(data, o).end()
        return [{"in_place": all(data.startswith(first(x).lstrip(), behind(o)) for x, o in parts), "within_bound": all(len(x.encode()) <= T.CHUNK_BYTES * 3 // 2 for x, _ in parts), "whole": squeezed("".join(x for x, _ in parts)) == squeezed(text)}]

    rows = table(spark, d, "documents").filter(F.regexp_replace("text", r"\s+", "") != "")
    return rows.select("doc_id", F.inline(F.udf(check, "array<struct<in_place:boolean,within_bound:boolean,whole:boolean>>", useArrow=True)("text")))
