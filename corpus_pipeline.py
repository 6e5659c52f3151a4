"""The corpus pipeline over documents: language, near duplicates, benchmark passages, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm import decontaminate, jaccard, langid, mixing, token_ids
from siftwood.llm.common import released, removed, saved, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shingles of this many words link documents at this similarity (percent).
SHINGLE_WORDS, SIMILARITY = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those that the nearest-centroid classifier rejects go.

    It is fitted on a bounded sample of the labelled rows; null, empty and letterless texts are rejected.
    Repeated rows stay or go together. An empty table, or one without labels, gives no rows.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    return langid.identify(docs, model, keep=COLUMNS).filter("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id (null comes last), then the smallest row hash.

    Rows are told apart by a hash of id and text (another one if two rows ever collide), so rows of a null
    or repeated id are compared like all others, and of equal rows the one with the smallest other columns stays.
    Groups and winners are found from narrow columns; texts are shuffled once.
    """
    docs, seed = docs.select(*COLUMNS), 0
    row = lambda seed: F.xxhash64(F.lit(seed), F.isnull("doc_id"), F.isnull("text"), "doc_id", "text")
    while not docs.select(row(seed).alias("_row"), row(-1).alias("_other")).groupBy("_row").agg((F.min("_other") < F.max("_other")).alias("more")).filter("more").isEmpty():
        seed += 1
    keyed = docs.withColumn("_row", row(seed))
    groups = jaccard.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY, 100)
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = keyed.select("_row", "doc_id").distinct()
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "_row")).alias("w")
    winners = saved(ids.join(groups, "_row").groupBy("component_id").agg(first).select(F.col("w._row").alias("_row")), shared_dir(spark))
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = keyed.join(winners, "_row").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct(*rest)).alias("r"))
    return one.select("doc_id", "text", *[F.col("r")[c].alias(c) for c in rest]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts have none, and an empty benchmark removes nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs.select(*COLUMNS), benchmark, keep=COLUMNS).filter("n_hit = 0").select(*COLUMNS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources meet their target weights, in shuffled order; null sources are one source."""
    return mixing.poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def token_id_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards; a row per document of what is read back from them. Null texts are the end id alone."""
    return token_ids.token_table(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixture),
    ("token-ID output", token_id_shards),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input.

    Stages take the columns of documents and ignore others. A stage's table is deleted once the one
    behind it is written; the last one stays.
    """
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{work}/stage{k}")
        if k:
            removed(spark, f"{work}/stage{k - 1}")
        released(spark)
    return docs
