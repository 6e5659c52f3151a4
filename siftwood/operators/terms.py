"""The term dictionary of a stored index: patterns and fuzzy words become the terms they stand for, and only those are looked up.

Terms have postings of their own two-letter grams, with marks at both ends. A fuzzy word with k edits keeps one of k + 1 pieces
whole, a wildcard pattern its literal runs, so a few grams lead to all terms that may match; these are tested one by one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signs for the ends of a term; they are in no term, as terms are of letters and digits.
START, END = "^", "$"
#: Expanded terms that are looked up one by one; a pattern of more is tested on the postings.
MOST_TERMS = 1024


def write_terms(spark: SparkSession, folder: str) -> None:
    """Write the dictionary of an index that search.write_index() wrote: terms (field, term, size, df, cf) and grams (field, gram, term), both sorted."""
    posts = spark.read.parquet(f"{folder}/postings")
    terms = posts.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("size", F.length("term"))
    terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    marked = F.concat(F.lit(START), "term", F.lit(END))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size") + 1), lambda i: F.substring(marked, i, F.lit(2))))
    rows = terms.select("field", F.explode(grams).alias("gram"), "term")
    rows.repartitionByRange("field", "gram", "term").sortWithinPartitions("field", "gram", "term").write.mode("overwrite").parquet(f"{folder}/grams")


def _fuzzy_grams(word: str, edits: int) -> list[str] | None:
    """A gram of each of edits + 1 pieces of a word, of which a term within so many edits has one; None for words too short for that."""
    marked, pieces = START + word + END, edits + 1
    if len(marked) < 2 * pieces:
        return None
    width = len(marked) // pieces
    return sorted({marked[i * width : i * width + 2] for i in range(pieces)})


def _literal_grams(pattern: str) -> list[str]:
    """Grams that every term of a wildcard pattern has: of its longest literal run, the marked ends included."""
    runs = re.split(r"[*?]+", START + pattern + END)
    longest = max(runs, key=len)
    return [longest[i : i + 2] for i in range(len(longest) - 1)]


def _prefix(pattern: str) -> str:
    """Letters that every match of a regular expression begins with."""
    if "|" in pattern:
        return ""
    head = re.match(r"\w*", pattern)[0]
    return head[:-1] if pattern[len(head) : len(head) + 1] in ("*", "?", "{", "+") and head else head


def expanded(spark: SparkSession, folder: str, field: str, kind: str, text: str, word: str, edits: int, test: Column) -> DataFrame:
    """The terms of a field that a pattern stands for: kind fuzzy, wild or regex; text as it was written, word as search reads it, test on the column term."""
    terms, grams = spark.read.parquet(f"{folder}/terms").filter(F.col("field") == field), spark.read.parquet(f"{folder}/grams").filter(F.col("field") == field)
    if kind == "fuzzy":
        wanted = _fuzzy_grams(word, edits)
        if wanted is None:
            return terms.filter((F.col("size") <= len(word) + edits) & test).select("term")
        return grams.filter(F.col("gram").isin(wanted)).filter(F.length("term").between(len(word) - edits, len(word) + edits)).select("term").distinct().filter(test)
    if kind == "wild" and (wanted := _literal_grams(text.lower())):
        return grams.filter(F.col("gram") == wanted[len(wanted) // 2]).select("term").filter(test)
    head = _prefix(text) if kind == "regex" else ""
    return (terms.filter(F.col("term").startswith(head)) if head else terms).filter(test).select("term")


def matching(spark: SparkSession, folder: str, field: str, kind: str, text: str, word: str, edits: int, test: Column) -> Column:
    """A test on postings for the terms of a pattern: their names, which the scan can skip by, or the pattern itself where they are too many."""
    found = [r.term for r in expanded(spark, folder, field, kind, text, word, edits, test).limit(MOST_TERMS + 1).collect()]
    return test if len(found) > MOST_TERMS else F.col("term").isin(sorted(found)) if found else F.lit(False)
