"""Merging results of many answerers: keyword lookups, swarm queries, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions.text import is_infohash

#: Score of an answerer that nothing is known about; the highest merged swarm score.
UNKNOWN_SCORE, MAX_SWARM_SCORE = 0.5, 1000


def _first(value: Column, empty: Column, order: Column) -> Column:
    """The first value in an order that isn't empty; empty if there is none."""
    return F.coalesce(F.min_by(value, F.when(value.isNotNull() & (value != empty), order)), empty)


def lookup_counts(asked: DataFrame, answers: DataFrame, key: str = "publisher") -> DataFrame:
    """One row: asked, responded (without an error) and hits returned. answers: key, failed, n_hits."""
    return asked.select(key).distinct().join(answers, key, "left").agg(F.count("*").alias("asked"), F.count_if(F.col("failed") == F.lit(False)).alias("responded"), F.coalesce(F.sum(F.when(~F.col("failed"), F.col("n_hits"))), F.lit(0)).alias("returned"))


def merge_lookup(hits: DataFrame, scores: DataFrame | None = None, known_good: DataFrame | None = None) -> DataFrame:
    """Keyword-lookup hits merged by infohash and ranked.

    hits: publisher, infohash, name, size, seeders, files. Rows without a valid infohash go. The first
    value in order of publisher that isn't empty wins for name, size and files; seeders is the
    maximum; sources are sorted. The score is the mean score of its sources (unknown: 0.5) plus 0.05
    for each further source up to 0.2, plus 0.25 if known_good has the infohash, cut to 0..1. Rows are
    ordered by known_good, score, number of sources (all descending), name and infohash.
    """
    hits = hits.filter(is_infohash(F.col("infohash"))).withColumn("infohash", F.lower("infohash"))
    if scores is not None:
        hits = hits.join(scores.select("publisher", "score"), "publisher", "left")
    else:
        hits = hits.withColumn("score", F.lit(UNKNOWN_SCORE))
    order = F.struct("publisher", "name", "size")
    merged = hits.groupBy("infohash").agg(
        _first(F.col("name"), F.lit(""), order).alias("name"),
        F.max("seeders").alias("seeders"),
        _first(F.col("size"), F.lit(0).cast("long"), order).alias("size"),
        _first(F.col("files"), F.lit(0).cast("long"), order).alias("files"),
        F.array_sort(F.collect_set("publisher")).alias("sources"),
        F.avg(F.coalesce("score", F.lit(UNKNOWN_SCORE))).alias("mean_score"),
    )
    if known_good is not None:
        merged = merged.join(known_good.select(F.lower("infohash").alias("infohash")).distinct().withColumn("known_good", F.lit(True)), "infohash", "left")
    else:
        merged = merged.withColumn("known_good", F.lit(None).cast("boolean"))
    merged = merged.withColumn("known_good", F.coalesce("known_good", F.lit(False)))
    bonus = F.least((F.size("sources") - 1) * F.lit(0.05), F.lit(0.2)) + F.when(F.col("known_good"), 0.25).otherwise(0.0)
    return merged.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean_score") + bonus)), 6)).drop("mean_score")


def ranked_lookup(merged: DataFrame, limit: int) -> DataFrame:
    return merged.orderBy(F.desc("known_good"), F.desc("score"), F.desc(F.size("sources")), "name", "infohash").limit(limit)


def fan_out(query_keywords: DataFrame, indexers: DataFrame, postings: DataFrame) -> DataFrame:
    """Hits of every active indexer for every query keyword: an equi-join on (publisher, keyword); only tables of checked size are broadcast, by the planner."""
    wanted = postings.join(query_keywords.select("keyword").distinct(), "keyword", "left_semi")
    return wanted.join(indexers.select("publisher").distinct(), "publisher", "left_semi")


def unresolved(indexers: DataFrame, pointers: DataFrame) -> DataFrame:
    """Indexers without a resolved index pointer, which take the plain path."""
    return indexers.join(pointers.select("publisher").distinct(), "publisher", "left_anti")


def merge_swarm(hits: DataFrame) -> DataFrame:
    """Swarm answers merged by infohash: scores add up to 1000 at most, seeders is the maximum, matches are chained.

    hits: peer, infohash, name, size, seeders, rank, matches. First values go by peer.
    """
    hits = hits.filter(is_infohash(F.col("infohash"))).withColumn("infohash", F.lower("infohash"))
    order = F.struct("peer", "name", "size")
    chained = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("peer", "matches"))), lambda x: F.coalesce(x.matches, F.array())))
    return hits.groupBy("infohash").agg(
        _first(F.col("name"), F.lit(""), order).alias("name"),
        _first(F.col("size"), F.lit(0).cast("long"), order).alias("size"),
        F.max("seeders").alias("seeders"),
        F.least(F.sum("rank"), F.lit(MAX_SWARM_SCORE)).cast("long").alias("score"),
        chained.alias("matches"),
        F.array_sort(F.collect_set("peer")).alias("sources"),
    )


def ranked_swarm(merged: DataFrame, limit: int) -> DataFrame:
    return merged.orderBy(F.desc("score"), F.desc("seeders"), "infohash").limit(limit)


def compact_hits(hits: DataFrame) -> DataFrame:
    """A responder's local hits by infohash: the rank of its first hit, its first name and size, and the files of its content hits in order.

    hits: position, infohash, doc_type, name, size, score, file_path.
    """
    at = F.col("position")
    files = F.transform(F.array_sort(F.collect_list(F.when(F.col("doc_type") == "content", F.struct(at.alias("at"), F.col("file_path"))))), lambda x: x.file_path)
    return hits.groupBy("infohash").agg(F.min_by((F.col("score") * 1000).cast("long"), at).alias("rank"), _first(F.col("name"), F.lit(""), at).alias("name"), _first(F.col("size"), F.lit(0).cast("long"), at).alias("size"), files.alias("matches"))


def answer_limit(asked: Column) -> Column:
    """A responder's limit: outside 1..100 it is 50."""
    return F.when(asked.between(1, 100), asked).otherwise(50)


def admission_code(query: Column, scope: Column, shares: Column, file_hits: Column, content_hits: Column) -> Column:
    """Why a query is refused, or null: too_short, not_sharing, no_file_hits, no_content_hits."""
    return (
        F.when(~shares, "not_sharing")
        .when(F.length(F.trim(query)) < 2, "too_short")
        .when(F.contains(scope, F.lit("f")) & ~file_hits, "no_file_hits")
        .when(F.contains(scope, F.lit("c")) & ~content_hits, "no_content_hits")
    )


def wire_filters(hits: DataFrame, lang: str | None = None, min_size: int | None = None, max_size: int | None = None, not_ih: DataFrame | None = None) -> DataFrame:
    """The declared result filters, all optional and off by default."""
    for value, test in ((lang, F.col("lang") == lang if lang else None), (min_size, F.col("size") >= (min_size or 0)), (max_size, F.col("size") <= (max_size or 0))):
        hits = hits if value is None else hits.filter(test)
    return hits if not_ih is None else hits.join(not_ih.select("infohash"), "infohash", "left_anti")


def layered(layers: dict[str, DataFrame], dedupe: bool = False) -> DataFrame:
    """Results of several layers in one table, each row with its layer; dedupe keeps one row an infohash: the best score, layers in order."""
    out = None
    for i, (name, df) in enumerate(layers.items()):
        df = df.withColumn("layer", F.lit(name)).withColumn("_at", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if dedupe:
        rest = [c for c in out.columns if c not in ("infohash", "_at")]
        out = out.groupBy("infohash").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("_at"))).alias("r")).select("infohash", *[F.col(f"r.{c}").alias(c) for c in rest])
        return out
    return out.drop("_at")


def swarm_counts(targets: DataFrame, answers: DataFrame, deadline_ms: int) -> DataFrame:
    """One row: asked, responded in time, rejected. answers: peer, latency_ms, rejected."""
    in_time = answers.filter(F.col("latency_ms") <= deadline_ms)
    return targets.select("peer").distinct().join(in_time, "peer", "left").agg(F.count_distinct("peer").alias("asked"), F.count_if(F.col("rejected") == F.lit(False)).alias("responded"), F.count_if(F.col("rejected")).alias("rejected"))


def silent_targets(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """Targets that didn't answer, whose failures go up by one."""
    return targets.join(answers.select("peer").distinct(), "peer", "left_anti")


#: Results of a request over HTTP: default and most.
HTTP_DEFAULT, HTTP_MOST = 50, 500


def http_limit(asked: Column) -> Column:
    """Results that a request over HTTP gets."""
    return F.when(F.coalesce(asked, F.lit(0)) <= 0, F.lit(HTTP_DEFAULT)).otherwise(F.least(asked, F.lit(HTTP_MOST)))
