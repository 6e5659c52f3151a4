"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Unit vectors at cosine c lie sqrt(2 - 2c) apart. Projections on Gaussian directions, quantised to
cells of a width, agree with a probability that falls with that distance; a bucket is a cell of
several projections, and several tables of buckets are kept. What travels to the buckets is an id, its
buckets and the vector rounded to bytes with the size of that error: most pairs are decided by bounds on the
cosine, the few between the bounds by the vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, connected, dealt_join, mixed, saved, shared_dir, tidy

#: Least cosine of a link, cell width, and the least chance of a link at that cosine to be found.
COSINE, WIDTH, RECALL = 0.9, 2.0, 0.97
#: Vectors of a bucket that meet in one task; larger buckets are cut into blocks that meet pairwise.
BLOCK = 2048
#: Rows of a block whose cosines are held at once.
CHUNK = 256
#: Unrelated vectors that share a bucket, about, which sets the number of projections: large buckets are cheap
#: to compare and need few tables.
CROWD = 1024
#: Buckets of several blocks that are sent to every task (24 bytes each); beyond it they meet the rows by a join.
SENT_BUCKETS = 1 << 20


def agreement(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for two points at this distance."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a bucket, tables) for n vectors: buckets stay as crowded, and recall as high, at every size."""
    near, far = agreement(math.sqrt(2 - 2 * cosine)), agreement(math.sqrt(2))
    k = max(2, math.ceil(math.log(n / CROWD) / -math.log(far))) if n > CROWD else 2
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _buckets(v: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of each unit vector in each table."""
    rng = np.random.Generator(np.random.PCG64([seed, v.shape[1]]))
    cells = np.floor((v @ rng.standard_normal((v.shape[1], k * tables)) + rng.uniform(0, WIDTH, k * tables)) / WIDTH).astype(np.int64)
    out = np.full((len(v), tables), v.shape[1], np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, j * tables : (j + 1) * tables].astype(np.uint64))
    return (out >> np.uint64(32)).astype(np.uint32)


def _units(rows: list) -> list[np.ndarray]:
    """Unit vectors in double precision."""
    big = [np.array(x, np.float64) for x in rows]
    big = [x / np.abs(x).max() for x in big]
    return [x / np.linalg.norm(x) for x in big]


def _hashed(vectors: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """id, weight, code (the unit vector in bytes), scale, error (its distance from the unit vector) and buckets (one uint32 a table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _units(b.column("v").to_pylist())
            width = np.array([len(x) for x in unit])
            found: list = [b""] * len(unit)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for i, h in zip(at, _buckets(np.stack([unit[j] for j in at]), k, tables, seed), strict=True):
                    found[i] = h.tobytes()
            scale = np.array([np.abs(x).max() / 127 for x in unit])
            code = [np.rint(x / c).astype(np.int8) for x, c in zip(unit, scale, strict=True)]
            error = [float(np.linalg.norm(x - q * c)) for x, q, c in zip(unit, code, scale, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("weight"), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(scale), pa.array(error, pa.float64()), pa.array(found, pa.binary())], names=["id", "weight", "code", "scale", "error", "buckets"])

    return vectors.mapInArrow(tidy(run), "id long, weight long, code binary, scale double, error double, buckets binary")


def _spread(hashed: DataFrame, whole: bool) -> DataFrame:
    """A row per vector and table: slot, bucket and id; if whole, all of the vector's columns with the buckets of the slots before."""
    more = ["weight", "code", "scale", "error"] if whole else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 128):
                part = b.slice(start, 128)
                raw = part.column("buckets").to_pylist()
                h = np.stack([np.frombuffer(x, np.uint32) for x in raw])
                n, t = h.shape
                take = pa.array(np.repeat(np.arange(n), t))
                columns = [pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(h.reshape(-1).astype(np.int64)), part.column("id").take(take), *[part.column(c).take(take) for c in more]]
                if whole:
                    columns.append(pa.array([x[: 4 * j] for x in raw for j in range(t)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "bucket", "id", *more, *(["earlier"] if whole else [])])

    schema = "slot int, bucket long, id long" + (", weight long, code binary, scale double, error double, earlier binary" if whole else "")
    return hashed.mapInArrow(tidy(run), schema)


def _links(cosine: float):
    def run(key, table):
        slot, left, right = key[0].as_py(), key[2].as_py(), key[3].as_py()
        table = table.sort_by("id")
        ids, weight, block, scale, error = (table.column(c).to_numpy() for c in ("id", "weight", "block", "scale", "error"))
        v = np.stack([np.frombuffer(x, np.int8) for x in table.column("code").to_pylist()]).astype(np.float32)
        h = np.stack([np.frombuffer(x, np.uint32) for x in table.column("earlier").to_pylist()])
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        found = []
        for i in range(0, len(a), CHUNK):
            c, d = a[i : i + CHUNK], b[i:] if left == right else b
            near = (v[c] @ v[d].T) * (scale[c, None] * scale[d])
            slack = error[c, None] + error[d] * (1 + error[c, None]) + 1e-5
            x, y = np.nonzero(near + slack >= cosine)
            sure = near[x, y] - slack[x, y] >= cosine
            x, y = c[x], d[y]
            once = x < y if left == right else np.ones(len(x), bool)
            once &= (h[x] != h[y]).all(1)  # else an earlier table has the pair
            found.append((x[once], y[once], sure[once]))
        x, y, sure = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        p, q = x[~sure], y[~sure]
        x, y = x[sure], y[sure]
        count = np.bincount(x, weight[y], len(ids)) + np.bincount(y, weight[x], len(ids))
        label = np.arange(len(ids))
        while True:
            low = label.copy()
            np.minimum.at(low, x, label[y])
            np.minimum.at(low, y, label[x])
            low = low[low]
            if (low == label).all():
                break
            label = low
        hit = np.flatnonzero(count)
        n = pa.array(np.concatenate([count[hit].astype(np.int64), np.zeros(len(p), np.int64)]), mask=np.arange(len(hit) + len(p)) >= len(hit))
        return pa.table({"id": np.concatenate([ids[hit], ids[p]]), "n": n, "to": np.concatenate([ids[label[hit]], ids[q]])})

    return run


def _checked(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) whose cosine, in double precision, is large enough, with the weights of both."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), F.col("weight").alias(f"w{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            u, w = (_units(x.column(c).to_pylist()) for c in ("va", "vb"))
            near = np.array([float(p @ q) for p, q in zip(u, w, strict=True)]) >= cosine
            yield pa.RecordBatch.from_arrays([x.column(c) for c in ("a", "b", "wa", "wb")], names=["a", "b", "wa", "wb"]).filter(pa.array(near))

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb", "va", "vb")
    return rows.mapInArrow(tidy(run), "a long, b long, wa long, wb long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, seed: int = 5) -> DataFrame:
    """Links and components of vectors(vec_id, embedding) by cosine.

    Returns per row vec_id, n_links (other vectors at the least cosine that share a bucket in some
    table), component_id (the smallest vec_id reachable by links) and kept (it is its own
    component_id). Every reported link holds in double precision; one at exactly
    `cosine` is found with probability `recall`, closer ones more often. Null and zero vectors and
    those with null or non-finite components link with nothing; vectors of other lengths neither.
    Equal vectors are one node of their number, so copies aren't compared with each other. vec_id
    must be unique; rows of a null vec_id link with nothing. Other columns are ignored, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 2048)
    work = shared_dir(spark)
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) | ~F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding"), F.coalesce(~bad & F.col("vec_id").isNotNull(), F.lit(False)).alias("good"))
    rows = rows.withColumn("k1", F.when(F.col("good"), F.xxhash64("embedding"))).withColumn("k2", F.when(F.col("good"), F.hash("embedding")))
    good = rows.filter("good")
    nodes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min_by("embedding", "vec_id").alias("v"))
    nodes = saved(nodes, f"{work}/nodes")
    known = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("weight"), F.lit(0)).alias("rows")).first()
    k, tables = plan(known.nodes, cosine, recall)
    hashed = saved(_hashed(nodes.select("id", "weight", "v"), k, tables, seed), f"{work}/hashed")
    large = _spread(hashed.select("id", "buckets"), False).groupBy("slot", "bucket").count().filter(F.col("count") > BLOCK)
    large = saved(large.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).select("slot", "bucket", "blocks"), f"{work}/large")
    dealt = _spread(hashed, True).join(F.broadcast(large) if large.count() <= SENT_BUCKETS else large, ["slot", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "slot"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "blocks")
    pieces = ["slot", "bucket", "left", "right"]
    dealt = dealt.repartition(*[F.col(c) for c in pieces])  # so that the pieces of a large bucket are dealt to many tasks
    found = saved(dealt.groupBy(*pieces).applyInArrow(_links(cosine), "id long, n long, to long"), f"{work}/found")
    pairs = _checked(found.filter("n is null").select(F.col("id").alias("a"), F.col("to").alias("b")), nodes, cosine)
    pairs = saved(pairs, f"{work}/pairs")
    each = found.filter("n is not null").select("id", "n").union(pairs.select("a", "wb")).union(pairs.select("b", "wa"))
    counts = each.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected(found.filter("n is not null and id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).union(pairs.select("a", "b")), f"{work}/parts")
    facts = nodes.select("k1", "k2", "id", "weight").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    facts = facts.select("k1", "k2", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    facts = saved(facts, f"{work}/facts")
    out = dealt_join(good.select("vec_id", "k1", "k2"), facts, ["k1", "k2"], "weight", known.rows).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
