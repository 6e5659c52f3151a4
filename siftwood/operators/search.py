"""Ranked full-text search: index tables, the query language, BM25, highlights."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.functions.text import SEARCH_STOP_WORDS, analysed, highlight
from siftwood.session import spread

#: BM25 parameters and result limits.
K1, B = 1.2, 0.75
DEFAULT_LIMIT, MAX_LIMIT = 20, 10_000


def indexed(docs: DataFrame, key: str, text_fields: list[str], exact_fields: list[str] = ()) -> DataFrame:
    """The index table: key, one array of terms per text field (field_terms), exact fields as they are, texts for highlights.

    A text field may be a string or an array of strings, which is read as one text.
    """
    text = lambda f: F.array_join(F.col(f), " ") if isinstance(docs.schema[f].dataType, T.ArrayType) else F.col(f)
    return docs.select(key, *exact_fields, *text_fields, *[analysed(text(f)).alias(f"{f}_terms") for f in text_fields])


def postings(index: DataFrame, key: str, field: str) -> DataFrame:
    """Rows (key, term, tf, positions); partition them by term to look terms up without a scan.

    A row's terms are grouped within the row, so postings aren't shuffled; only those of rows that share their key meet.
    """
    twice = index.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_twice"))
    if twice.isEmpty():
        return _own_postings(index, key, field)
    shared = F.col(key).eqNullSafe(F.col("_twice"))
    once, rest = (_own_postings(index.join(twice, shared, how), key, field) for how in ("left_anti", "left_semi"))
    return once.unionByName(rest.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")))


def _own_postings(index: DataFrame, key: str, field: str) -> DataFrame:
    """Rows (key, term, tf, positions) of each row by itself: its terms are sorted, and places where a term begins cut them into runs."""
    rows = _behind(index, [key], {"_s": F.sort_array(F.transform(f"{field}_terms", lambda t, i: F.struct(t.alias("term"), i.alias("at"))))})
    begins = F.filter(F.transform("_s", lambda x, i: F.when((i == 0) | (F.get("_s", i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
    rows = _behind(rows, [key, "_s"], {"_b": begins})

    def run(b: Column, k: Column) -> Column:
        n = F.coalesce(F.get("_b", k + 1), F.size("_s")) - b
        return F.struct(F.get("_s", b)["term"].alias("term"), n.cast("long").alias("tf"), F.transform(F.slice("_s", b + 1, n), lambda x: x["at"]).alias("positions"))

    return rows.select(key, F.inline(F.transform("_b", run)))


def vocabulary(index: DataFrame, field: str) -> DataFrame:
    """Rows (term, df, cf): documents that hold a term and its occurrences."""
    # Sorted terms tell each document's first occurrence of a term from the later ones without a shuffle by document.
    rows = index.select(F.array_sort(f"{field}_terms").alias("s"))
    first = F.transform("s", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get("s", i - 1) != t)).alias("first")))
    return rows.select(F.explode(first).alias("x")).groupBy("x.term").agg(F.count_if("x.first").alias("df"), F.count("*").alias("cf"))


@dataclass(frozen=True)
class Clause:
    occur: str  # should, must, not
    field: str | None
    kind: str  # term, phrase, fuzzy, regex, wild, range
    text: str
    edits: int = 0
    boost: float = 1.0
    op: str = ""


@dataclass(frozen=True)
class Part:
    """A clause on one field: of an exact field (test) or of a text field's words."""

    clause: int
    field: str
    words: tuple[str, ...] = ()
    test: Column | None = None


_CLAUSE = re.compile(
    r'(?P<occur>[+-]?)(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|/(?P<regex>(?:[^/\\]|\\.)+)/|(?P<op>[<>]=?)(?:"(?P<quoted>[^"]*)"|(?P<bound>[^\s"^]+))|(?P<word>[^\s"~^]+))(?:~(?P<edits>\d*))?(?:\^(?P<boost>\d+(?:\.\d+)?))?'
)


def parse(query: str) -> list[Clause]:
    """Clauses of a query string: w, +w, -w, "a b", field:w, w~N, w^N, w*, /re/, field:>=n. An empty query raises ValueError."""
    out = []
    for m in _CLAUSE.finditer(query):
        occur = {"+": "must", "-": "not", "": "should"}[m["occur"]]
        word = m["word"] or ""
        kind = "phrase" if m["phrase"] is not None else "regex" if m["regex"] else "range" if m["op"] else "fuzzy" if m["edits"] is not None else "wild" if set(word) & set("*?") else "term"
        text = {"phrase": m["phrase"], "regex": m["regex"], "range": m["quoted"] if m["quoted"] is not None else m["bound"]}.get(kind, word)
        out.append(Clause(occur, m["field"], kind, text, int(m["edits"] or 1) if kind == "fuzzy" else 0, float(m["boost"] or 1), m["op"] or ""))
    if not out:
        raise ValueError("empty query")
    return out


def _terms(text: str) -> list[str]:
    """Search terms of a query's text, by the rule that cuts the index: runs of letters and decimal digits."""
    kept = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text.lower())
    return [w for w in kept.split() if w not in SEARCH_STOP_WORDS]


def _words(c: Clause) -> tuple[str, ...]:
    """The words that a clause asks of a text field; a pattern is one word."""
    if c.kind == "regex":
        return (c.text,)
    if c.kind == "wild":
        return ("".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in c.text.lower()),)
    return tuple(_terms(c.text)[: 1 if c.kind == "fuzzy" else None])


def _is(c: Clause, word: str, term: Column) -> Column:
    """Whether a term of the index is a clause's word."""
    if c.kind == "fuzzy":
        return F.levenshtein(term, F.lit(word), c.edits) >= 0
    return term.rlike(f"^(?:{word})$") if c.kind in ("regex", "wild") else term == word


def _exact(c: Clause, field: str, kind: T.DataType) -> Column:
    """The test of a clause on a stored value."""
    col = F.col(field)
    if c.kind == "range":
        bound = F.lit(c.text).cast(kind)
        return {">": col > bound, ">=": col >= bound, "<": col < bound, "<=": col <= bound}[c.op]
    if c.kind in ("regex", "wild"):
        return F.lower(col.cast("string")).rlike(f"^(?:{_words(c)[0]})$")
    return F.lower(col.cast("string")) == c.text.lower()


def _parts(clauses: list[Clause], schema: T.StructType, text_fields: list[str], exact_fields: list[str]) -> list[Part]:
    out = []
    for i, c in enumerate(clauses):
        for f in [c.field] if c.field else list(text_fields):
            if f in exact_fields:
                out.append(Part(i, f, test=_exact(c, f, schema[f].dataType)))
            elif f not in text_fields or c.kind == "range":
                out.append(Part(i, f, test=F.lit(False)))
            elif words := _words(c):
                out.append(Part(i, f, words))
    return out


def _minus(j: int):
    return lambda at: at - j


def _shifted(found: Column, j: int) -> Column:
    """The places of occurrences, j before."""
    return F.transform(found, lambda x: x["at"] - j)


def _frequency(c: Clause, words: tuple[str, ...], found: Column) -> Column:
    """How often a clause occurs among found(term, at), the occurrences of the query's words in a field."""
    of = lambda w: F.filter(found, lambda x: _is(c, w, x.term))
    if c.kind != "phrase" or len(words) == 1:
        return F.least(*[F.size(of(w)) for w in words]) if len(words) > 1 else F.size(of(words[0]))
    starts = None
    for j, w in enumerate(words):  # places where the phrase would start; hashed, so linear in the occurrences
        at = _shifted(of(w), j)
        starts = at if starts is None else F.array_intersect(starts, at)
    return F.size(starts)


def _occurrence(wanted: list[tuple[Clause, str]]):
    """A function of a term and its place: both, if the term is any of the wanted words."""
    plain = sorted({w for c, w in wanted if c.kind in ("term", "phrase")})

    def hit(t: Column, i: Column) -> Column:
        test = t.isin(plain) if plain else F.lit(False)
        for c, w in wanted:
            test = test if c.kind in ("term", "phrase") else test | _is(c, w, t)
        return F.when(test, F.struct(t.alias("term"), i.alias("at")))

    return hit


def _behind(df: DataFrame, keep: list[str], new: dict[str, Column]) -> DataFrame:
    """Columns to keep and new ones, computed once a row: a generator, so that no filter or later expression repeats them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()])))) if new else df.select(*keep)


def _frequencies(index: DataFrame, clauses: list[Clause], parts: list[Part], text_fields: list[str]) -> DataFrame:
    """index without its terms, with _n{j} (frequency of part j) and _len_{field}."""
    keep = [c for c in index.columns if c not in [f"{f}_terms" for f in text_fields]]
    rows = _behind(index, keep, {f"_t_{f}": F.col(f"{f}_terms") for f in text_fields})
    found = {}
    for f in text_fields:
        wanted = [(clauses[p.clause], w) for p in parts if p.field == f and p.test is None for w in p.words]

        if wanted:
            found[f"_h_{f}"] = F.filter(F.transform(f"_t_{f}", _occurrence(wanted)), lambda x: x.isNotNull())
        found[f"_len_{f}"] = F.size(f"_t_{f}")
    rows = _behind(rows, keep, found)
    n = {f"_n{j}": (p.test.cast("int") if p.test is not None else _frequency(clauses[p.clause], p.words, F.col(f"_h_{p.field}"))) for j, p in enumerate(parts)}
    return _behind(rows, [*keep, *[f"_len_{f}" for f in text_fields]], {k: F.coalesce(v, F.lit(0)) for k, v in n.items()})


def _scored(rows: DataFrame, clauses: list[Clause], parts: list[Part], facts: dict) -> DataFrame:
    """The rows that match, with their score; facts: n, avg_{field}, df{j}."""
    score, by_clause = F.lit(0.0), {i: F.lit(False) for i in range(len(clauses))}
    for j, p in enumerate(parts):
        tf, boost = F.col(f"_n{j}"), clauses[p.clause].boost
        by_clause[p.clause] = by_clause[p.clause] | (tf > 0)
        if clauses[p.clause].occur == "not":
            continue
        if p.test is not None:
            score = score + F.when(tf > 0, F.lit(boost)).otherwise(0.0)
            continue
        n, df, mean = facts["n"], facts[f"df{j}"], facts[f"avg_{p.field}"] or 1.0
        idf = F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5))
        score = score + F.lit(boost) * idf * tf * (K1 + 1) / (tf + F.lit(K1) * (1 - B + B * F.col(f"_len_{p.field}") / F.lit(float(mean))))
    usable = {p.clause for p in parts}
    match = F.lit(True)
    must = [i for i, c in enumerate(clauses) if c.occur == "must" and i in usable]
    for i in must:
        match = match & by_clause[i]
    for i in (i for i, c in enumerate(clauses) if c.occur == "not" and i in usable):
        match = match & ~by_clause[i]
    if not must:
        some = F.lit(False)
        for i in (i for i, c in enumerate(clauses) if c.occur == "should" and i in usable):
            some = some | by_clause[i]
        match = match & some
    return rows.filter(match).withColumn("score", F.round(score, 6))


def _facts(rows: DataFrame, n_parts: int, text_fields: list[str]) -> dict:
    counts = [F.count_if(F.col(f"_n{j}") > 0).alias(f"df{j}") for j in range(n_parts)]
    return rows.agg(F.count("*").alias("n"), *[F.avg(f"_len_{f}").alias(f"avg_{f}") for f in text_fields], *counts).first().asDict()


def matches(index: DataFrame, query: str, text_fields: list[str], exact_fields: list[str] = (), filters: Column | None = None) -> DataFrame:
    """All rows that a query matches, with their score.

    A clause without a field searches every text field; field:v on an exact field compares stored
    values, field:>=v is a range of them. Must clauses all match, not clauses never do, and without
    must clauses at least one should clause matches. A hit's score sums boost * BM25 over clauses and
    text fields (an exact hit counts its boost).

    Corpus statistics take one pass of narrow aggregates; ranking is a second pass with a top-k per
    task, so no shuffle carries texts. write_index() and search_index() read stored postings instead.
    """
    clauses = parse(query)
    parts = _parts(clauses, index.schema, text_fields, exact_fields)
    rows = _frequencies(index if filters is None else index.filter(filters), clauses, parts, text_fields)
    return _scored(rows, clauses, parts, _facts(rows, len(parts), text_fields))


def _limit(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)


def search(index: DataFrame, query: str, key: str, text_fields: list[str], exact_fields: list[str] = (), limit: int = DEFAULT_LIMIT, filters: Column | None = None, with_highlights: bool = False, stored: list[str] = ()) -> DataFrame:
    """The top hits of a query: key, score, the stored fields asked for, and fragments if asked; ties are ordered by key.

    limit <= 0 means 20; it is cut at 10,000. Stored fields are columns of the index.
    """
    stored = [c for c in stored if c not in (key, "score")]
    out = matches(index, query, text_fields, exact_fields, filters).orderBy(F.desc("score"), key).limit(_limit(limit))
    if with_highlights:
        words = sorted({w for c in parse(query) if c.occur != "not" and c.kind in ("term", "phrase", "fuzzy") for w in _terms(c.text)})
        fragments = F.map_from_arrays(F.array(*[F.lit(f) for f in text_fields]), F.array(*[highlight(F.coalesce(F.col(f), F.lit("")), words) for f in text_fields]))
        return out.select(key, "score", *stored, F.map_filter(fragments, lambda _, v: F.size(v) > 0).alias("fragments"))
    return out.select(key, "score", *stored)


def write_index(docs: DataFrame, key: str, text_fields: list[str], folder: str, exact_fields: list[str] = (), stored: list[str] = ()) -> None:
    """Write an index: postings sorted by field and term, so that a term reads only the row groups that may hold it, and documents.

    postings: field, term, key, tf, positions. documents: key, exact and stored fields, lengths. One row a key is expected.
    """
    # What is read twice is kept for the time: terms by documents and postings, as a sort by ranges reads its rows once more to find the ranges.
    spark, kept = docs.sparkSession, list(dict.fromkeys([key, *exact_fields, *stored]))
    index = indexed(spread(docs.select(*dict.fromkeys([*kept, *text_fields]))), key, text_fields, [c for c in kept if c != key and c not in text_fields])
    index = index.drop(*[f for f in text_fields if f not in kept])
    index.write.mode("overwrite").parquet(f"{folder}/_terms_of")
    index = spark.read.schema(index.schema).parquet(f"{folder}/_terms_of")
    rows = None
    for f in text_fields:
        part = postings(index, key, f).select(F.lit(f).alias("field"), "term", F.col(key).alias("key"), "tf", "positions")
        rows = part if rows is None else rows.unionByName(part)
    rows.write.mode("overwrite").parquet(f"{folder}/_unsorted")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/_unsorted")
    rows.repartitionByRange("field", "term", "key").sortWithinPartitions("field", "term", "key").write.mode("overwrite").parquet(f"{folder}/postings")
    index.select(*kept, *[F.size(f"{f}_terms").alias(f"_len_{f}") for f in text_fields]).write.mode("overwrite").parquet(f"{folder}/documents")
    for name in ("_terms_of", "_unsorted"):
        scratch = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        scratch.getFileSystem(spark._jsc.hadoopConfiguration()).delete(scratch, True)


def search_index(spark: SparkSession, folder: str, query: str, key: str, text_fields: list[str], exact_fields: list[str] = (), limit: int = DEFAULT_LIMIT, stored: list[str] = (), dictionary: bool = False) -> DataFrame:
    """The hits that search() gives, from an index written by write_index(): key, score, stored fields.

    Only postings of the query's words are read; their frequencies meet the documents by an equi-join. With a
    dictionary, which terms.write_terms() adds to the index, patterns and fuzzy words are expanded to terms first, and
    only the postings of these are read; otherwise they are tested on all.
    """
    from siftwood.operators.terms import matching

    clauses = parse(query)
    docs = spark.read.parquet(f"{folder}/documents")
    parts = _parts(clauses, docs.schema, text_fields, exact_fields)
    wanted, columns, final = F.lit(False), [], []
    for j, p in enumerate(parts):
        c = clauses[p.clause]
        if p.test is not None:
            continue
        tests = [_is(c, w, F.col("term")) for w in p.words]
        if dictionary and c.kind in ("fuzzy", "wild", "regex"):
            tests = [matching(spark, folder, p.field, c.kind, c.text, w, c.edits, x) for w, x in zip(p.words, tests, strict=True)]
        here = [(F.col("field") == p.field) & x for x in tests]
        for x in here:
            wanted = wanted | x
        if c.kind == "phrase" and len(here) > 1:
            columns += [F.max(F.when(x, F.transform("positions", _minus(i)))).alias(f"_p{j}_{i}") for i, x in enumerate(here)]
            starts = F.col(f"_p{j}_0")
            for i in range(1, len(here)):
                starts = F.array_intersect(starts, F.col(f"_p{j}_{i}"))
            final.append(F.coalesce(F.greatest(F.size(starts), F.lit(0)), F.lit(0)).alias(f"_n{j}"))
        else:
            columns += [F.sum(F.when(x, F.col("tf"))).alias(f"_w{j}_{i}") for i, x in enumerate(here)]
            each = [F.coalesce(F.col(f"_w{j}_{i}"), F.lit(0)) for i in range(len(here))]
            final.append((F.least(*each) if len(each) > 1 else each[0]).alias(f"_n{j}"))
    texts = docs.agg(F.count("*").alias("n"), *[F.avg(f"_len_{f}").alias(f"avg_{f}") for f in text_fields]).first().asDict()
    if not columns:
        rows, counts = docs, {}
    else:
        found = spark.read.parquet(f"{folder}/postings").filter(wanted).groupBy(F.col("key").alias(key)).agg(*columns).select(key, *final)
        names = [c for c in found.columns if c != key]
        counts = found.agg(*[F.count_if(F.col(c) > 0).alias("df" + c[2:]) for c in names]).first().asDict()
        narrow = all(p.test is None for p in parts) or any(clauses[p.clause].occur == "must" and p.test is None for p in parts)
        rows = docs.join(found, key, "inner" if narrow else "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    rows = rows.withColumns({f"_n{j}": F.coalesce(p.test.cast("int"), F.lit(0)) for j, p in enumerate(parts) if p.test is not None})
    out = _scored(rows, clauses, parts, texts | counts)
    return out.orderBy(F.desc("score"), key).limit(_limit(limit)).select(key, "score", *[c for c in stored if c not in (key, "score")])


def total_hits(index: DataFrame, query: str, text_fields: list[str], exact_fields: list[str] = ()) -> DataFrame:
    """One row: the number of all matches."""
    return matches(index, query, text_fields, exact_fields).agg(F.count("*").alias("total"))


def blended_rank(text_scores: Column, files_score: Column, content_score: Column, seeders: Column, age_seconds: Column) -> Column:
    """The optional blend of scores, seeders and freshness, in thousandths."""
    fresh = F.exp(-age_seconds / F.lit(30 * 86400.0))
    blend = 0.4 * text_scores + 0.2 * files_score + 0.2 * content_score + 0.1 * F.log(seeders + F.lit(1.0)) + 0.1 * fresh
    return (blend * 1000).cast("long")

