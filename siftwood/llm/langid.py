"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, packed, tidy, unpacked

#: Hashed n-gram dimensions.
DIMS = 1 << 13
#: Bound on the labelled sample: documents per language, and languages.
SAMPLE_PER_LANG, MAX_LANGS = 400, 400
#: Centroids per language.
CENTROIDS = 4
#: Rejection radii: this quantile of the cosine distances of labelled texts that the centroids weren't fitted
#: on, plus this margin, by language and length class (powers of 4 of the n-grams); a class needs so many texts.
QUANTILE, MARGIN, LEAST_TEXTS, CLASSES = 0.99, 0.1, 20, 16
#: Beyond this distance a text of any length is rejected.
FARTHEST = 0.95
#: Rows of a language that are ordered to find its sample, as a multiple of it.
SPARE = 4

_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[: 0x80] = [c if chr(c).isalpha() else 32 for c in range(0x80)]
_CHUNK_BYTES, _CHUNK_DOCS = 1 << 19, 128


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script; digits of other kinds, such as fractions, are none."""
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams (lower case, other ASCII as spaces) of whole texts: one row each."""
    gap = b"   "  # three spaces, so that no n-gram reaches over two texts
    raw = [gap + t.lower().encode("utf-8", "surrogatepass") + gap for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    b = _SPACED[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends, prepend=0))
    two = b[:-1] | (b[1:] << np.uint32(8))
    three = two[:-1] | (b[2:] << np.uint32(16))
    keep2, keep3 = two != 0x2020, ((three & 0xFFFF) != 0x2020) & ((three >> np.uint32(8)) != 0x2020)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    h2 = ((two[keep2] + np.uint32(0x51ED)) * np.uint32(2654435761)) >> shift
    h3 = ((three[keep3] ^ np.uint32(0x9E3779)) * np.uint32(2246822519)) >> shift
    at = np.concatenate([doc[:-1][keep2] * DIMS + h2, doc[:-2][keep3] * DIMS + h3])
    return np.bincount(at, minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


def length_class(counts: np.ndarray) -> np.ndarray:
    """The class of each row's number of n-grams."""
    total = np.maximum(counts.sum(1), 1)
    return np.minimum((np.log2(total) / 2).astype(np.int64), CLASSES - 1)


@dataclass
class LangModel:
    """idf by dimension; unit centroids with their languages; rejection radii by language and length class."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF vectors of rows of n-gram counts."""
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (cosine to the nearest centroid) and rejected, of each text."""
        lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        use = [i for i, t in enumerate(texts) if has_letter(t)]
        start = 0
        while start < len(use) and self.langs:
            stop, size = start, 0
            while stop < len(use) and stop - start < _CHUNK_DOCS and (stop == start or size + len(texts[use[stop]]) <= _CHUNK_BYTES):
                size += len(texts[use[stop]])
                stop += 1
            part = use[start:stop]
            counts = ngram_counts([texts[i] for i in part])
            cos = self.vectors(counts) @ self.centroids.T
            best = cos.argmax(1)
            top = np.clip(cos[np.arange(len(part)), best], 0, 1)
            for i, k in zip(part, best, strict=True):
                lang[i] = self.langs[self.owner[k]]
            score[part], rejected[part] = np.round(top.astype(np.float64), 6), 1 - top > self.radius[self.owner[best], length_class(counts)]
            start = stop
        return lang, score, rejected


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with far-first starts: unit centroids."""
    picked = [0]
    near = v @ v[0]
    while len(picked) < min(k, len(v)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, v @ v[picked[-1]])
    c = v[picked].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        new = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def _centroids(model: LangModel, counts: np.ndarray, names: np.ndarray, k: int) -> None:
    """Fit idf and centroids."""
    seen = (counts > 0).sum(0)
    model.idf = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
    parts = [clustered(model.vectors(counts[names == j]), k) for j in range(len(model.langs)) if (names == j).any()]
    here = [j for j in range(len(model.langs)) if (names == j).any()]
    model.centroids = np.concatenate(parts)
    model.owner = np.repeat(here, [len(c) for c in parts])


def _radii(distance: np.ndarray, kind: np.ndarray, names: np.ndarray, langs: int, margin: float) -> np.ndarray:
    """Radii by language and class. A class with too few texts takes all languages' texts; one that still has
    too few takes the radius of the next longer class, or of the next shorter one beyond the longest; shorter
    classes never have smaller radii than longer ones."""
    out = np.full((langs, CLASSES), np.nan)
    for j in range(langs):
        for c in range(CLASSES):
            near = distance[(kind == c) & (names == j)]
            near = near if len(near) >= LEAST_TEXTS else distance[kind == c]
            if len(near) >= LEAST_TEXTS:
                out[j, c] = np.quantile(near, QUANTILE) + margin
        known = np.flatnonzero(~np.isnan(out[j]))
        if not len(known):
            out[j] = 1.0
            continue
        out[j, known[-1] + 1 :] = out[j, known[-1]]
        out[j, : known[0]] = 1.0  # too short to be judged
        for c in range(CLASSES - 2, -1, -1):
            out[j, c] = out[j, c + 1] if np.isnan(out[j, c]) else max(out[j, c], out[j, c + 1])
    return np.minimum(out, FARTHEST)


def fitted_counts(counts: np.ndarray, langs: list[str], centroids: int = CENTROIDS, margin: float = MARGIN) -> LangModel:
    """Fit the model on rows of n-gram counts of labelled texts.

    Radii come from two halves: each is measured against centroids fitted on the other one. The
    centroids that predict are then fitted on all rows.
    """
    names = sorted(set(langs))
    model = LangModel(names, np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.full((len(names), CLASSES), FARTHEST))
    if not names:
        return model
    own = np.array([names.index(x) for x in langs])
    half, distance = np.zeros(len(own), bool), np.full(len(own), np.nan)
    for j in range(len(names)):
        half[np.flatnonzero(own == j)[::2]] = True
    for part in (half, ~half):
        if not part.any() or part.all():
            continue
        _centroids(model, counts[part], own[part], centroids)
        cos = model.vectors(counts[~part]) @ model.centroids.T
        cos[model.owner[None, :] != own[~part][:, None]] = -1
        distance[~part] = 1 - cos.max(1, initial=-1)
    measured = ~np.isnan(distance) & (distance <= 1)
    model.radius = _radii(distance[measured], length_class(counts)[measured], own[measured], len(names), margin)
    _centroids(model, counts, own, centroids)
    return model


def fitted(texts: list[str], langs: list[str], centroids: int = CENTROIDS, margin: float = MARGIN) -> LangModel:
    """Fit the model on labelled texts."""
    rows = [(t, x) for t, x in zip(texts, langs, strict=True) if has_letter(t)]
    counts = np.concatenate([ngram_counts([t]) for t, _ in rows]) if rows else np.zeros((0, DIMS))
    return fitted_counts(counts, [x for _, x in rows], centroids, margin)


def _labelled_counts(rows: DataFrame) -> DataFrame:
    """doc_id, lang and the packed n-gram counts of rows(doc_id, text, lang) whose text has a letter; texts stay in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, x, packed(ngram_counts([t])[0].astype(np.uint32))) for d, t, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.binary())], names=["doc_id", "lang", "counts"])

    return rows.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, counts binary")


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> LangModel:
    """Fit on at most per_lang documents of each of at most MAX_LANGS languages.

    labelled: doc_id, text, lang. The sample is the documents of a language with the smallest hash
    of doc_id, found from narrow columns: languages are counted, the largest MAX_LANGS stay, and only rows
    whose hash lies below SPARE times the wanted share are ordered. Of rows that repeat a doc_id and
    language one stays. Whole texts are counted in the tasks, and only the n-gram counts,
    of a size that doesn't depend on the text, reach the driver.
    """
    arrow_rows(labelled.sparkSession)
    named = labelled.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("ids"), "lang").limit(MAX_LANGS)
    hashed = named.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).join(F.broadcast(sizes), "lang")
    near = hashed.filter(F.pmod("h", F.lit(1 << 52)) <= F.lit(float(SPARE * per_lang << 52)) / F.col("ids")).distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang).select("doc_id", "lang").collect()
    if not chosen:
        return fitted_counts(np.zeros((0, DIMS)), [])
    picks = labelled.sparkSession.createDataFrame([(r.doc_id, r.lang) for r in chosen], "doc_id long, lang string").distinct()
    counted = _labelled_counts(named.join(F.broadcast(picks), ["doc_id", "lang"])).groupBy("doc_id", "lang").agg(F.min("counts").alias("counts")).collect()  # a row for each pick
    counted.sort(key=lambda r: (r.doc_id, r.lang))
    return fitted_counts(np.stack([unpacked(r.counts, np.uint32) for r in counted]) if counted else np.zeros((0, DIMS)), [r.lang for r in counted], centroids)


def identify(docs: DataFrame, model: LangModel, keep: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text: the columns in keep (default doc_id) with lang_pred, score, rejected.

    lang_pred is the language of the nearest centroid, `und` if text is null, empty or has no
    letter; score is the cosine to that centroid (0 to 1, 0 for und). rejected is true for und
    and where the cosine distance exceeds the radius of that language for texts of that length: a
    high quantile of the distances of labelled texts outside the fit, plus a margin. Equal texts get equal rows; ties go to the language that sorts first.
    Columns of docs named like the new ones are left out of keep.
    """
    arrow_rows(docs.sparkSession)
    names = [c for c in (keep or ["doc_id"]) if c not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: MAX_LANGS * CENTROIDS rows of DIMS
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = shared.value.predict(b.column("_text").to_pylist())
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(tidy(run), schema)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of doc_id as text leaves this remainder; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
