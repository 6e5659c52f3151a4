"""The term dictionary: expansions equal a test of all terms, and read few of them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftwood.operators import search, terms
from siftwood.session import work_dir


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcé1") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12))) for i in range(150)] + [(900, None), (901, "")], "doc_id long, text string")
    folder = work_dir(spark)
    search.write_index(docs, "doc_id", ["text"], folder)
    terms.write_terms(spark, folder)
    return docs, folder, {r.term for r in spark.read.parquet(f"{folder}/terms").collect()}


def near(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("text", ["abca~1", "ab~1", "b~1", "abcabc~2", "cébab~2", "c1~2", "ab*", "*ba", "*bc*", "a?c*", "?b", "*", "zz*", "/ab+c.*/", "/a?b.*/", "/(ab|ba).*/", "/[ab]c/", "/ab{2}.*/"])
def test_expansions_equal_a_test_of_all_terms(spark, stored, text):
    _, folder, known = stored
    (c,) = search.parse(text)
    (word,) = search._words(c)
    got = {r.term for r in terms.expanded(spark, folder, "text", c.kind, c.text, word, c.edits, search._is(c, word, F.col("term"))).collect()}
    assert got == {t for t in known if (near(t, word) <= c.edits if c.kind == "fuzzy" else re.fullmatch(word, t))}


def test_searches_equal_those_of_texts(spark, stored, monkeypatch):
    docs, folder, _ = stored
    index = search.indexed(docs, "doc_id", ["text"])
    for most in (1024, 3):
        monkeypatch.setattr(terms, "MOST_TERMS", most)
        for q in ("abca~1 +/b.*/", "ab* -*c", "a?c* cab~2", "zzz*"):
            want = [(r.doc_id, r.score) for r in search.search(index, q, "doc_id", ["text"], limit=200).collect()]
            assert [(r.doc_id, r.score) for r in search.search_index(spark, folder, q, "doc_id", ["text"], limit=200, dictionary=True).collect()] == want


def test_short_lists_are_read_by_name(spark, stored):
    _, folder, _ = stored
    (c,) = search.parse("abca~1")
    test = terms.matching(spark, folder, "text", c.kind, c.text, "abca", 1, search._is(c, "abca", F.col("term")))
    plan = spark.read.parquet(f"{folder}/postings").filter(test)._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and "PushedFilters: [" in plan and ("In(term" in plan or "EqualTo(term" in plan or "term,[" in plan)
