"""Hard negatives by exact inner product over k-means inverted lists.

Rows lie in the list of their nearest centroid, and each list knows its radius. By Cauchy-Schwarz the score of an
anchor with any row of a list lies within |anchor| * radius of its score with the centroid. Anchors
visit lists by falling upper bound, in rounds of growing size: a list whose bounds miss the window of scores, or
whose upper bound is below the worst score kept so far, is skipped. What is left of the lists is compared in
blocks of anchors against blocks of rows, so results are exact whatever the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, packed, removed, saved, shared_dir, tidy, unpacked

#: Rows that the centroids are fitted on, the most centroids, and the rounds of fitting. Every row is indexed.
SAMPLE, MOST_LISTS, STEPS = 20_000, 1024, 6
#: Rows of a block, anchors of a group (on average), and blocks that a group meets in one join key.
BLOCK, GROUP, SLICE = 4096, 512, 16
#: Lists visited in the first round, and how many times more in each further one.
FIRST, GROWTH = 16, 8
#: Bytes of a row group of blocks.
BLOCK_BYTES = 16 << 20
#: Anchors whose scores with a block are held at once.
CHUNK = 128
#: Rows that hold whole blocks or groups which are sent to Python, or read from Parquet, at once.
FEW, FEW_READ = 4, 16
#: Lists of vectors of another length have other numbers.
_WIDTH = 1 << 16
_NO_ID = (1 << 63) - 1


def quantised(embedding):
    """floor(256 x) of each component x in double precision; null where any component is null or not finite."""
    e = embedding.cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(e, lambda x: F.floor(x * 256).cast("double")))


def fitted(rows: list[np.ndarray], k: int, steps: int = STEPS) -> dict[int, np.ndarray]:
    """Centroids by vector length, from rows of a sample: k-means from rows spread over the sample."""
    out, by_width = {}, {}
    for x in rows:
        by_width.setdefault(len(x), []).append(x)
    for width, part in by_width.items():
        x = np.unique(np.stack(part), axis=0)
        n = max(1, min(len(x), round(k * len(part) / len(rows))))
        rng = np.random.Generator(np.random.PCG64([7, width]))
        c = x[np.sort(rng.permutation(len(x))[:n])]
        for _ in range(steps):
            near = _nearest(x, c)[0]
            size = np.bincount(near, minlength=n)
            sums = np.stack([np.bincount(near, x[:, j], n) for j in range(width)], 1) if width else np.zeros((n, 0))
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        out[width] = c
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it, measured from the difference itself."""
    near = np.concatenate([np.argmin((c * c).sum(1) - 2 * (x[i : i + 2048] @ c.T), 1) for i in range(0, len(x), 2048)])
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


@contextmanager
def _short_batches(spark: SparkSession):
    """Batches of few rows, for rows that hold whole blocks: in Arrow, and in the Parquet reader, which otherwise holds 4,096 rows of a task decoded at once."""
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": FEW, "spark.sql.parquet.columnarReaderBatchSize": FEW_READ}
    held = {name: spark.conf.get(name, None) for name in few}
    for name, rows in few.items():
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, old in held.items():
            spark.conf.unset(name) if old is None else spark.conf.set(name, old)


_TYPES = {2: "<i2", 4: "<i4", 8: "<f8"}


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers in the shortest type that holds all of them exactly."""
    with np.errstate(invalid="ignore"):
        for kind in ("<i2", "<i4"):
            if np.array_equal(short := x.astype(kind), x):
                return short
    return x.astype("<f8")


def _shut(x: np.ndarray) -> bytes:
    """Numbers as packed bytes behind the size of their type."""
    return bytes([x.itemsize]) + packed(x.reshape(-1))


def _open(data: bytes, n: int) -> np.ndarray:
    """What _shut() packed, as n rows in double precision."""
    return unpacked(data[1:], _TYPES[data[0]]).astype(np.float64).reshape(n, -1)


def _assigned(rows: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """Rows with the list they belong to and their distance from its centroid; a length that the sample lacks has one list around zero."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.array(x, np.float64) for x in b.column("v").to_pylist()]
            width = np.array([len(x) for x in v])
            where, far = np.zeros(len(v), np.int64), np.zeros(len(v))
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                near, distance = _nearest(np.stack([v[i] for i in at]), sent.value.get(w, np.zeros((1, w))))
                where[at], far[at] = w * _WIDTH + near, distance
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("anchor"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(where), pa.array(far)], names=["vec_id", "label", "anchor", "v", "list", "far"])

    return rows.mapInArrow(tidy(run), "vec_id long, label long, anchor boolean, v binary, list long, far double")


def _blocked(assigned: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """The inverted lists as blocks: list, slice, n, radius, ids, labels and vectors (packed), each block ordered by id."""
    pieces = F.create_map(*[F.lit(x) for kv in sorted((k, -(-n // BLOCK)) for k, n in sizes.items() if n > BLOCK) for x in kv]) if any(n > BLOCK for n in sizes.values()) else None
    piece = F.lit(0) if pieces is None else F.pmod(F.xxhash64("vec_id", "label", "v"), F.coalesce(pieces[F.col("list")], F.lit(1))).cast("int")
    rows = assigned.withColumn("piece", piece).repartition("list", "piece").sortWithinPartitions("list", "piece", "vec_id")

    def block(key: tuple, rows: list) -> dict:
        order = sorted(rows, key=lambda r: r[0])
        ids, labels, v, far = zip(*order, strict=True)
        return {"list": key[0], "slice": key[1] // SLICE, "n": len(ids), "radius": max(far), "ids": packed(np.array(ids, np.int64)), "labels": packed(np.array(labels, np.int64)), "vectors": _shut(_narrow(np.frombuffer(b"".join(v))))}

    schema = pa.schema([("list", pa.int64()), ("slice", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            ids = [_NO_ID if x is None else x for x in b.column("vec_id").to_pylist()]
            for at, *row in zip(zip(b.column("list").to_pylist(), b.column("piece").to_pylist(), strict=True), ids, b.column("label").to_pylist(), b.column("v").to_pylist(), b.column("far").to_pylist(), strict=True):
                if held and (at != key or len(held) >= 2 * BLOCK):
                    yield pa.RecordBatch.from_pylist([block(key, held)], schema)
                    held = []
                key = at
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([block(key, held)], schema)

    return rows.mapInArrow(tidy(run), "list long, slice int, n long, radius double, ids binary, labels binary, vectors binary")


def _requests(groups: DataFrame, index: dict[int, tuple], start: int, stop: int) -> DataFrame:
    """For each group the lists that its anchors visit in this round, with the anchors that do.

    index: by vector length, the numbers, centroids, radii and slices of lists. An anchor visits the lists of ranks
    start to stop by falling upper bound that may hold a row for one of its targets: the bound reaches
    the lower end of the target's window and the worst score kept for it, and the least possible score is not beyond the upper end.
    Besides their aids, members come packed: vec_ids, labels and vectors, and by target its number, lowest and highest score.
    """
    sent = groups.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members in b.column("members").to_pylist():
                by_width: dict[int, list] = {}
                for m in members:
                    by_width.setdefault(len(m["v"]) // 8, []).append(m)
                for width, part in by_width.items():
                    if width not in sent.value:
                        continue
                    names, centroids, radii, slices = sent.value[width]
                    a = np.frombuffer(b"".join(m["v"] for m in part)).reshape(len(part), width)
                    length = np.sqrt((a * a).sum(1))[:, None]
                    middle = a @ centroids.T
                    reach = length * radii
                    slack = 1e-9 * (length * np.sqrt((centroids * centroids).sum(1)) + reach) + 1e-6
                    upper, lower = middle + reach + slack, middle - reach - slack
                    rank = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1, kind="stable")
                    shape = (len(part), max(len(m["targets"]) for m in part))
                    target, low, high = np.full(shape, -1, np.int32), np.full(shape, np.inf), np.full(shape, -np.inf)
                    for i, m in enumerate(part):
                        for j, t in enumerate(m["targets"]):
                            target[i, j], low[i, j], high[i, j] = t["target"], max(t["low"], t["worst"]), t["high"]
                    want = np.zeros(upper.shape, bool)
                    for j in range(shape[1]):
                        want |= (upper >= low[:, j, None]) & (lower <= high[:, j, None])
                    want &= (rank >= start) & (rank < stop)
                    aids, labels = (np.array([m[c] for m in part], np.int64) for c in ("aid", "label"))
                    ids, short = np.array([_NO_ID if m["vec_id"] is None else m["vec_id"] for m in part], np.int64), _narrow(a)
                    for c in np.flatnonzero(want.any(0)):
                        who = np.flatnonzero(want[:, c])
                        row = [pa.array([x], pa.binary()) for x in (packed(ids[who]), packed(labels[who]), _shut(short[who]), *(packed(x[who].reshape(-1)) for x in (target, low, high)))]
                        own = pa.ListArray.from_arrays(pa.array([0, len(who)], pa.int32()), pa.StructArray.from_arrays([pa.array(aids[who])], ["aid"]))
                        for s in range(slices[c]):
                            yield pa.RecordBatch.from_arrays([pa.array([names[c]], pa.int64()), pa.array([s], pa.int32()), own, *row], names=["list", "slice", "members", *_MEMBERS])

    return groups.mapInArrow(tidy(run), f"list long, slice int, members array<struct<aid:long>>, {', '.join(f'{x} binary' for x in _MEMBERS)}")


#: Packed columns of a request.
_MEMBERS = ("vec_ids", "own_labels", "anchors", "targets", "lows", "highs")


def _best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, the first columns among equals; -inf never counts."""
    n = scores.shape[1]
    k = min(k, n)
    most = np.abs(scores, where=np.isfinite(scores), out=np.zeros_like(scores)).max(initial=0)
    if most * n < 1 << 52:  # scores are whole numbers: the column decides between equals
        key = scores * n - np.arange(n)
        at = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    i = np.repeat(np.arange(len(scores)), k)
    c = at.reshape(-1)
    fine = np.isfinite(scores[i, c])
    return i[fine], c[fine]


def _scored(pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows of each block for each target of the anchors that visit it: aid, target, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members, *own, ids, labels, vectors in zip(b.column("members"), *(b.column(c).to_pylist() for c in (*_MEMBERS, "ids", "labels", "vectors")), strict=True):
                aids, n = members.values.field("aid").to_numpy(), len(members.values)
                vec_ids, own_labels = (unpacked(x, np.int64) for x in own[:2])
                anchors, targets, lows, highs = _open(own[2], n), *(unpacked(x, kind).reshape(n, -1) for x, kind in zip(own[3:], (np.int32, np.float64, np.float64), strict=True))
                ids, labels = unpacked(ids, np.int64), unpacked(labels, np.int64)
                rows = _open(vectors, len(ids))
                found = []
                for start in range(0, n, CHUNK):
                    part = slice(start, start + CHUNK)
                    scores, aid = anchors[part] @ rows.T, aids[part]
                    label = own_labels[part, None]
                    fit = labels == label if same else labels != label
                    if same:
                        fit &= ids != vec_ids[part, None]
                    for j in range(targets.shape[1]):
                        use = fit & (scores >= lows[part, j, None]) & (scores <= highs[part, j, None])
                        some = np.flatnonzero(use.any(1))
                        i, c = _best_of(np.where(use[some], scores[some], -np.inf), k)
                        i = some[i]
                        found.append((aid[i], targets[part, j][i], ids[c], np.clip(scores[i, c], -9.2e18, 9.2e18).astype(np.int64)))
                aid, target, near, score = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(aid), pa.array(target), pa.array(near), pa.array(score)], names=["aid", "target", "id", "score"])

    return pairs.select("members", *_MEMBERS, "ids", "labels", "vectors").mapInArrow(tidy(run), "aid long, target int, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each target, highest scores first, smaller ids among equals, with their rank from 1."""
    order = Window.partitionBy("aid", "target").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(anchors: DataFrame, targets: DataFrame, blocks: DataFrame, index: dict[int, tuple], same: bool, k: int, work: str) -> DataFrame:
    """The k best rows for each target (aid, target, low, high) of the anchors, among rows of the same or of other labels."""
    spark, most = anchors.sparkSession, max([len(x[0]) for x in index.values()], default=0)
    best, start, stop = None, 0, FIRST
    for r in range(100):
        if best is None:
            worst = targets.withColumn("worst", F.lit(float("-inf")))
        else:
            full = best.groupBy("aid", "target").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
            worst = targets.join(full.select("aid", "target", "least"), ["aid", "target"], "left").withColumn("worst", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
        each = worst.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("target", "low", "high", "worst"))).alias("targets"))  # k of them at most
        groups = anchors.join(each, "aid").groupBy("group").agg(F.collect_list(F.struct("aid", "vec_id", "label", "v", "targets")).alias("members"))
        with _short_batches(spark):
            # groups are few and short, what they ask for is neither: they are dealt to all cores, and the planner may not broadcast their requests
            asked = _requests(groups.select("members").repartition(spark.sparkContext.defaultParallelism), index, start, stop)
            found = _scored(asked.join(blocks.hint("merge"), ["list", "slice"]), same, k)
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            best = saved(_top(found, k), f"{work}/best{r}")
        if r:
            removed(spark, f"{work}/best{r - 1}")
        if stop >= most:
            return best
        start, stop = stop, stop * GROWTH
    raise RuntimeError("more lists than any index has")


def mine(vectors: DataFrame, anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the anchors among vectors(vec_id, label, v), v being arrays of whole numbers.

    anchor: a condition on these columns. Scores are inner products, exact as long as they stay below 2**53; higher ones
    come first, smaller vec_ids among equals, null ones last. The positives of an anchor are its first rows of the same label; for each of
    them the first rows of other labels whose score lies between low and high hundredths of the positive's are
    returned: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors without positives, and
    positives without negatives, have no rows.

    Rows of a null label, and null vectors, take no part. Equal rows count once. Of rows that share a
    vec_id none is a positive of another. Vectors of different lengths have no score. Other columns are ignored; an empty
    table gives no rows. Centroids are fitted on SAMPLE rows (those of the smallest hashes); their number is the square
    root of the number of rows, MOST_LISTS at most. Only centroids, radii and sizes of lists reach the driver.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 2048)
    work = shared_dir(spark)
    rows = vectors.filter("label is not null and v is not null").select("vec_id", F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("v").cast("array<double>").alias("v"))
    rows = saved(rows.distinct(), f"{work}/rows")
    n = rows.count()
    sample = rows.select("v", F.xxhash64("v", "vec_id", "label").alias("h")).orderBy("h").limit(SAMPLE).select("v")
    centroids = fitted([np.array(r.v, np.float64) for r in sample.collect()], max(1, min(MOST_LISTS, round(n**0.5))))
    assigned = saved(_assigned(rows, centroids), f"{work}/assigned")
    removed(spark, f"{work}/rows")
    sizes = {r["list"]: r["n"] for r in assigned.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = saved(_blocked(assigned, sizes), f"{work}/blocks", **{"parquet.block.size": BLOCK_BYTES})
    index: dict[int, tuple] = {}
    stats = sorted(map(tuple, blocks.groupBy("list").agg(F.max("radius"), F.max("slice")).collect()))
    for width in {x[0] // _WIDTH for x in stats}:
        own = [x for x in stats if x[0] // _WIDTH == width]
        middle = centroids.get(width, np.zeros((1, width)))
        index[width] = (np.array([x[0] for x in own]), middle[[x[0] % _WIDTH for x in own]], np.array([x[1] for x in own]), [x[2] + 1 for x in own])
    chosen = assigned.filter("anchor")
    count = chosen.count()
    group = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(max(1, -(-count // GROUP))))
    anchors = saved(chosen.select(F.monotonically_increasing_id().alias("aid"), "vec_id", "label", "v", group.alias("group")), f"{work}/anchors")
    removed(spark, f"{work}/assigned")
    whole = anchors.select("aid", F.lit(0).alias("target"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    near = _search(anchors, whole, blocks, index, True, positives, f"{work}/positives")
    hundredth = F.col("score").cast("decimal(38,0)")
    window = near.select("aid", F.col("rank").cast("int").alias("target"), F.ceil(hundredth * low / 100).cast("double").alias("low"), F.floor(hundredth * high / 100).cast("double").alias("high"))
    far = _search(anchors, window, blocks, index, False, negatives, f"{work}/negatives")
    own = near.select("aid", F.col("rank").alias("target"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(own, ["aid", "target"]).join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return out.withColumnRenamed("id", "negative_id").select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", F.col("score").alias("negative_score"))
