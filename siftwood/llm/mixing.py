"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, saved, shared_dir

#: Sources above this count aren't broadcast; rows of large sources are then dealt to several tasks.
BROADCAST_SOURCES = 20_000
#: Longest mean that one inversion draws; larger means are sums of draws.
CHUNK = 32.0
#: Name under which rows without a source are mixed.
NO_SOURCE = "\u0000"


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """One row per source: source_key, units (code points), rows, rate, and the Poisson distribution function.

    The target share of a source is its entry in `weights`, or units ** temperature if none are
    given (0: equal shares, 1: as found); sources missing from `weights` get share 0. rate is the
    mean repetition that turns the found units into share * budget * all units. A source of no
    units has rate 1.
    """
    key = F.coalesce("source", F.lit(NO_SOURCE))
    sums = docs.groupBy(key.alias("source_key")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("units"), F.count("*").alias("rows"))
    if weights is None:
        share = F.pow(F.col("units").cast("double"), F.lit(float(temperature)))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        share = F.coalesce(F.try_element_at(table, F.col("source_key")), F.lit(0.0))
    sums = sums.withColumn("share", F.round(share, 6).cast("decimal(30,6)"))
    sums = saved(sums, shared_dir(docs.sparkSession))
    total = sums.agg(F.sum("units").alias("units"), F.sum("share").alias("shares")).first()
    units, shares = float(total.units or 0), float(total.shares or 0)
    rate = F.when(F.col("units") == 0, F.lit(1.0))
    rate = rate.otherwise(F.col("share").cast("double") * F.lit(float(budget)) * F.lit(units) / (F.lit(shares) * F.col("units").cast("double")) if shares else F.lit(0.0))
    out = sums.withColumn("rate", rate)
    out = out.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(CHUNK)).cast("int"))).withColumn("mean", F.col("rate") / F.col("draws"))
    p0 = F.exp(-F.col("mean"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(160)),
        F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("cdf")),
        lambda s, k: F.struct((s.p * F.col("mean") / k).alias("p"), (s.c + s.p * F.col("mean") / k).alias("c"), F.concat(s.cdf, F.array(s.c + s.p * F.col("mean") / k)).alias("cdf")),
        lambda s: s.cdf,
    )
    return out.select("source_key", "units", "rows", "rate", "draws", steps.alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0, seed: int = 17) -> DataFrame:
    """Replicate each document a Poisson number of times so that sources meet their target weights; shuffle globally.

    Every column of docs is kept, with copy_no (1 to the document's count) and shuffle_key (the
    hash that orders the result) added; columns of these names are replaced. The count of a
    document inverts the Poisson distribution at a uniform number hashed from seed and doc_id, so
    it doesn't depend on partitioning; rows that repeat a doc_id get equal counts. Null text has
    no units, null sources form a source of their own, a null doc_id is hashed as `null`. An
    empty table stays empty. The table of rates is broadcast only if it is short.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    rates = repetition_rates(docs, weights, temperature, budget).select(F.col("source_key").alias("_key"), F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf"), F.col("rows").alias("_rows"))
    known = rates.agg(F.count("*").alias("sources"), F.sum("_rows").alias("rows")).first()
    short = known.sources <= BROADCAST_SOURCES
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda j: _uniform(F.lit(str(seed)), name, j.cast("string")))
    keyed = docs.withColumn("_key", F.coalesce("source", F.lit(NO_SOURCE)))
    drawn = keyed.join(F.broadcast(rates), "_key") if short else dealt_join(keyed, rates, ["_key"], "_rows", known.rows, ["doc_id"])
    # Generators, so that numbers are drawn and compared once a row whatever later filters say.
    drawn = drawn.select("*", F.inline(F.array(F.struct(draws.alias("_u")))))
    count = F.aggregate("_u", F.lit(0), lambda n, u: n + F.size(F.filter("_cdf", lambda c: c < u)))
    drawn = drawn.select("*", F.inline(F.array(F.struct(count.alias("_n")))))
    copies = drawn.filter("_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    mixed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), name, F.col("copy_no").cast("string"))))
    return mixed.drop("_key", "_draws", "_cdf", "_rows", "_u", "_n").repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key", "doc_id")
