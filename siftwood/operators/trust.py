"""Reputation, attribution, trust lists and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the score.
PRIOR_SCORE, PRIOR_WEIGHT, SEED_BONUS, SEED_HALF_LIFE_S = 0.5, 5.0, 0.45, 90 * 86400.0
#: Admission: strong endorsers needed, score of a strong one, least score by policy, most admitted.
ENDORSERS, STRONG, POLICY_SCORE, MOST_ADMITTED = 3, 0.5, 0.3, 100


def counters(events: DataFrame) -> DataFrame:
    """Counters by publisher from feedback events (publisher, kind: returned/confirmed/flagged, n, ts). Amounts up to 0 do nothing."""
    n = lambda kind: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("n") > 0), F.col("n"))), F.lit(0)).cast("long").alias(kind)
    return events.groupBy("publisher").agg(n("returned"), n("confirmed"), n("flagged"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_updated"))


def score(returned: Column, confirmed: Column, flagged: Column, seeded_at: Column | None = None, now: Column | None = None) -> Column:
    """Smoothed share of confirmed hits, plus a seed bonus that halves every 90 days, in 0..1."""
    organic = (F.greatest(confirmed - flagged, F.lit(0)) + PRIOR_SCORE * PRIOR_WEIGHT) / (F.greatest(returned, F.lit(1)) + PRIOR_WEIGHT)
    organic = F.when((returned == 0) & (confirmed == 0) & (flagged == 0), PRIOR_SCORE).otherwise(organic)
    if seeded_at is not None:
        age = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(seeded_at), F.lit(0))
        organic = organic + F.when(seeded_at.isNotNull(), F.lit(SEED_BONUS) * F.pow(F.lit(0.5), age / F.lit(SEED_HALF_LIFE_S))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), organic))


def trusted_enough(publishers: DataFrame, cutoff: float) -> DataFrame:
    """Publishers at or above a score; a cutoff that isn't above 0 lets all pass."""
    return publishers.filter(F.col("score") >= cutoff) if cutoff > 0 else publishers


def ranked(publishers: DataFrame, limit: int = 10) -> DataFrame:
    return publishers.orderBy(F.desc("score"), "publisher").limit(limit)


def sources(hits: DataFrame) -> DataFrame:
    """The set of publishers that returned each infohash."""
    return hits.groupBy("infohash").agg(F.array_sort(F.collect_set("publisher")).alias("sources"))


def attributed(marks: DataFrame, hits: DataFrame, publishers: DataFrame, fallback: str = "all") -> DataFrame:
    """Rows (publisher, n): how often a mark (infohash) falls on a publisher.

    A mark falls on the publishers that returned its infohash; one without any falls on every known
    publisher (fallback "all") or on none ("none"). Marks without a source are only counted, so the
    fallback adds one number to each publisher and no pair is ever made. Marks are counted by infohash first, so
    hits without a mark go before any are grouped.
    """
    counted = marks.groupBy("infohash").agg(F.count("*").alias("n"))
    pairs = hits.select("infohash", "publisher").join(counted, "infohash").groupBy("infohash", "publisher").agg(F.first("n").alias("n"))
    direct = pairs.groupBy("publisher").agg(F.sum("n").alias("n"))
    every = publishers.select("publisher").distinct().join(direct, "publisher", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if fallback == "all":
        found = pairs.groupBy("infohash").agg(F.first("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found"))
        every = every.join(F.broadcast(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("marks")))).join(F.broadcast(found))  # tables of one row
        every = every.withColumn("n", F.col("n") + F.col("marks") - F.col("found"))
    return every.select("publisher", "n").filter("n > 0")


def is_trusted(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows with trusted: whether signed_by is on the list, whatever its case."""
    names = trusted.select(F.lower("publisher").alias("_p")).distinct().withColumn("trusted", F.lit(True))
    return rows.join(names, F.lower("signed_by") == F.col("_p"), "left").drop("_p").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def admitted(anchors: DataFrame, endorsements: DataFrame, crawled: DataFrame, scores: DataFrame | None, known_good_configured: bool, lenient: bool = False, most: int = MOST_ADMITTED) -> DataFrame:
    """Publishers that are admitted, with reason (anchor, endorsed, policy).

    endorsements: endorser, candidate, announced; self-endorsements, empty keys and candidates never
    announced don't count. A candidate needs ENDORSERS distinct endorsers of a strong score (all count
    where scores is None; unknown endorsers have 0.5). Else a crawled publisher passes the policy: the filter is configured and
    its score is POLICY_SCORE or more; an unknown publisher has 0.5 if lenient, otherwise it fails.
    The first `most` stay: anchors, endorsed by number of endorsers, policy; ties by key.
    """
    edges = endorsements.filter("cast(endorser as string) <> '' and cast(candidate as string) <> '' and endorser <> candidate and announced").select("endorser", "candidate").distinct()
    if scores is not None:
        edges = edges.join(scores.select(F.col("publisher").alias("endorser"), "score"), "endorser", "left").filter(F.coalesce("score", F.lit(PRIOR_SCORE)) >= STRONG)
    endorsed = edges.groupBy("candidate").agg(F.count_distinct("endorser").alias("n")).filter(F.col("n") >= ENDORSERS)
    rows = anchors.select("publisher", F.lit("anchor").alias("reason"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    rows = rows.union(endorsed.select("candidate", F.lit("endorsed"), F.lit(1), "n"))
    if known_good_configured:
        pool = crawled.select("publisher").distinct()
        pool = pool.join(scores.select("publisher", "score"), "publisher", "left") if scores is not None else pool.withColumn("score", F.lit(None).cast("double"))
        pool = pool.filter(F.coalesce("score", F.lit(PRIOR_SCORE if lenient else 0.0)) >= POLICY_SCORE)
        rows = rows.union(pool.select("publisher", F.lit("policy"), F.lit(2), F.lit(0).cast("long")))
    best = rows.groupBy("publisher").agg(F.min_by(F.struct("reason", "at", "n"), F.struct("at", -F.col("n"))).alias("r")).select("publisher", "r.*")
    return best.orderBy("at", F.desc("n"), "publisher").limit(most).select("publisher", "reason")


def pending(endorsements: DataFrame, crawled: DataFrame, admitted_rows: DataFrame) -> DataFrame:
    """Publishers endorsed or observed that aren't admitted."""
    return endorsements.select(F.col("candidate").alias("publisher")).union(crawled.select("publisher")).distinct().join(admitted_rows.select("publisher"), "publisher", "left_anti")


def merged_anchors(own: DataFrame, fetched: DataFrame) -> DataFrame:
    """Anchors of both lists, valid keys only, each once."""
    both = own.select(F.lower("publisher").alias("publisher")).union(fetched.select(F.lower("publisher")))
    return both.filter(F.col("publisher").rlike("^[0-9a-f]{64}$")).distinct()


def seed_import(rows: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows of a seed list; another version than 1 raises ValueError."""
    if version != 1:
        raise ValueError(f"seed list version {version}")
    good = F.coalesce(F.lower("publisher").rlike("^[0-9a-f]{64}$"), F.lit(False))
    return rows.filter(good).withColumn("publisher", F.lower("publisher")), rows.filter(~good)


def running_ban(events: DataFrame, threshold: int = 100, hours: int = 24) -> DataFrame:
    """events (peer, ts, points) with the running total and whether it has reached the threshold: the first ban of each peer."""
    w = Window.partitionBy("peer").orderBy("ts", "points").rowsBetween(Window.unboundedPreceding, 0)
    total = events.withColumn("total", F.sum("points").over(w))
    first = total.filter(F.col("total") >= threshold).groupBy("peer").agg(F.min("ts").alias("banned_at"))
    return first.withColumn("until", F.col("banned_at") + F.expr(f"interval {hours} hours"))


def listed(trusted: DataFrame) -> DataFrame:
    """The trust list by publisher."""
    return trusted.orderBy("publisher")


def admission_counts(anchors: DataFrame, admitted_rows: DataFrame, waiting: DataFrame) -> DataFrame:
    """One row: anchors, admitted and pending publishers, each counted once."""
    count = lambda df, name: df.agg(F.count_distinct("publisher").alias(name))
    return count(anchors, "anchors").join(count(admitted_rows, "admitted")).join(count(waiting, "pending"))  # tables of one row
