"""Hard negatives: rows of other labels that score just below an anchor's positives.

Scores are integer inner products of quantized vectors.  An orthogonal rotation
onto the principal components (of the second moments of all rows, added up
partition by partition) puts most of a vector's length first.  Tasks
accumulate the partial products of the leading components; what the others can
add is bounded by the product of the residual norms, plus a slack for rounding,
so a pair whose bound can't reach its anchor's list, or can't fall below the
highest window, is discarded early.  The survivors are verified by products of
the integers themselves, so the rotation decides about time alone, never about
a result.

Anchors go through in blocks of ``BLOCK_BYTES`` at most, one after the other;
a block is broadcast, and tasks hold its lists and one slice of their rows.
Each pass over the rows gives a list per anchor and task, which Spark ranks.
A block's results are written before the next one begins.

Rows without an id or label, and vectors that are null or hold a null or a
component that is not finite, take no part.  Shorter vectors count as filled up
with zeros, empty ones with zeros alone.  Ties go to the smaller id.  Repeated
rows are rows like others, except that rows with the anchor's id are never its
positives; each of several rows of one anchor's id is an anchor.  An anchor
without positives, or whose windows hold nothing, has no rows in the result.
An empty table gives an empty result.  Ids and labels are integers.  Scores
beyond 2^56 are an error.  Only the three columns are read, so others may have
any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir, slices, stage, summed

#: Bytes of a block's vectors, and pairs of a slice of rows with a block.
BLOCK_BYTES, PAIRS = 1 << 22, 1 << 20
#: Shares of the components after which pairs are discarded.
LEADS = (0.375, 0.625, 0.875)
MOST = float(1 << 56)


def usable(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """id, label and v of the rows that take part."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce((x == x) & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))


def quantized(column: pa.Array, dims: int) -> np.ndarray:
    """A row of ``dims`` integral doubles for each vector."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = np.floor(256.0 * values)
    return out


def moments(rows: DataFrame, dims: int) -> np.ndarray:
    """The second moments of all vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((dims, dims)), None
        for batch in slices(batches, 4096):
            if batch.num_rows:
                part, q = batch.column(1)[0].as_py(), quantized(batch.column(0), dims)
                total += q.T @ q
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part] * dims, pa.int64()), pa.array(range(dims), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["part", "row", "v"])

    return summed(rows.select("v", F.spark_partition_id().cast("long")).mapInArrow(partial, "part long, row long, v array<double>"), dims, dims)


def rotation(second: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the directions of the greatest moments first."""
    scale = np.abs(second).max(initial=0.0)
    return np.linalg.eigh(second / scale)[1][:, ::-1].copy() if scale else np.eye(len(second))


class Turned:
    """Rotated vectors with the norms of what follows each lead."""

    def __init__(self, q: np.ndarray, axes: np.ndarray):
        self.q, self.r = q, q @ axes
        d = q.shape[1]
        self.cuts = sorted({min(d, int(np.ceil(d * x))) for x in LEADS})
        squares = np.cumsum(self.r[:, ::-1] ** 2, axis=1)[:, ::-1]
        rest = np.concatenate([squares, np.zeros((len(q), 1))], axis=1)
        self.rest = [np.sqrt(rest[:, c]) for c in self.cuts]
        self.norm = np.sqrt((q**2).sum(axis=1))


def survivors(a: Turned, x: Turned, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs asked for, those whose score can be from ``low`` to ``high`` of their anchor: anchor's place, row's place, exact score."""
    d = a.q.shape[1]
    if a.norm.max(initial=0) * x.norm.max(initial=0) > MOST:
        raise ArithmeticError("an inner product may not fit into an integer of 64 bits")
    # of the rotation (d products a component) and of the sums of d products
    slack = 8 * (d + 2) ** 2 * np.finfo(float).eps
    at = a.cuts[0] if a.cuts else 0
    found = a.r[:, :at] @ x.r[:, :at].T
    room = (np.outer(a.rest[0], x.rest[0]) if a.cuts else 0.0) + slack * np.outer(a.norm, x.norm)
    i, j = np.nonzero(asked & (found + room >= low[:, None]) & (found - room <= high[:, None]))
    scores = np.zeros(len(i), np.int64)
    stays = np.zeros(len(i), bool)
    for s in range(0, len(i), PAIRS // 16):
        own = np.arange(s, min(len(i), s + PAIRS // 16))
        part, done = found[i[own], j[own]], at
        for k in range(1, len(a.cuts)):
            cut = a.cuts[k]
            part = part + np.einsum("pc,pc->p", a.r[i[own], done:cut], x.r[j[own], done:cut])
            more = a.rest[k][i[own]] * x.rest[k][j[own]] + slack * a.norm[i[own]] * x.norm[j[own]]
            open_ = (part + more >= low[i[own]]) & (part - more <= high[i[own]])
            own, part, done = own[open_], part[open_], cut
        exact = np.einsum("pc,pc->p", a.q[i[own]].astype(np.int64), x.q[j[own]].astype(np.int64))
        scores[own], stays[own] = exact, (exact >= low[i[own]]) & (exact <= high[i[own]])
    return i[stays], j[stays], scores[stays]


class Lists:
    """The best ``most`` (score, id) of each of ``n`` keys, seen slice by slice."""

    def __init__(self, n: int, most: int):
        self.most, self.worst = most, np.full(n, -np.inf)
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        kept = place < self.most
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]
        full = place == self.most - 1
        self.worst[key[full]] = score[full]


def in_slices(batches: Iterator[pa.RecordBatch], anchors: int, dims: int, axes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Turned]]:
    """ids, labels and turned vectors of a few rows at a time."""
    for batch in slices(batches, max(1, min(4096, PAIRS // max(1, anchors)))):
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        yield ids, labels, Turned(quantized(batch.column(2), dims), axes)


def _best(found: DataFrame, keys: list[str], most: int, place: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn(place, F.row_number().over(order)).where(F.col(place) <= most)


def positives_of(rows: DataFrame, sent, dims: int, most: int) -> DataFrame:
    """a, id, score and place (from 1) of each anchor's best rows of its own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, q, axes, _ = sent.value
        a, lists = Turned(q, axes), Lists(len(q), most)
        for ids, labels, x in in_slices(batches, len(q), dims, axes):
            asked = (anchor_labels[:, None] == labels) & (anchor_ids[:, None] != ids)
            i, j, score = survivors(a, x, asked, lists.worst, np.full(len(q), np.inf))
            lists.add(i, score, ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(lists.key), pa.array(lists.id), pa.array(lists.score)], names=["a", "id", "score"])

    return _best(rows.mapInArrow(run, "a long, id long, score long"), ["a"], most, "place")


def negatives_of(rows: DataFrame, sent, dims: int, most: int, low: int, high: int) -> DataFrame:
    """w, id, score and rank of the best rows of other labels in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, anchor_labels, q, axes, (owner, score_of) = sent.value
        a, lists = Turned(q, axes), Lists(len(owner), most)
        # the windows of an anchor lie next to each other
        first = np.searchsorted(owner, np.arange(len(q)))
        count = np.searchsorted(owner, np.arange(len(q)), side="right") - first
        top = np.full(len(q), -np.inf)
        np.maximum.at(top, owner, score_of * high / 100)
        for ids, labels, x in in_slices(batches, len(q), dims, axes):
            least = np.full(len(q), np.inf)
            np.minimum.at(least, owner, np.maximum(np.ceil(score_of * low / 100), lists.worst))
            i, j, score = survivors(a, x, anchor_labels[:, None] != labels, least, top)
            w = np.repeat(first[i], count[i]) + np.arange(count[i].sum()) - np.repeat(np.cumsum(count[i]) - count[i], count[i])
            j, score = np.repeat(j, count[i]), np.repeat(score, count[i])
            fits = (low * score_of[w] <= 100 * score) & (100 * score <= high * score_of[w]) & (score >= lists.worst[w])
            lists.add(w[fits], score[fits], ids[j[fits]])
        yield pa.RecordBatch.from_arrays([pa.array(lists.key), pa.array(lists.id), pa.array(lists.score)], names=["w", "id", "score"])

    return _best(rows.mapInArrow(run, "w long, id long, score long"), ["w"], most, "rank")


def blocks_of(anchors: DataFrame, most: int) -> Iterator[DataFrame]:
    """The rows of ``anchors`` (with a number of their own each) in blocks of up to ``most``."""
    total = anchors.count()
    n = -(-total // most)
    while n:
        block = F.pmod(F.xxhash64("number"), F.lit(n))
        if anchors.groupBy(block).count().agg(F.max("count")).first()[0] <= most:
            yield from (anchors.where(block == b) for b in range(n))
            return
        n = n + max(1, n // 8)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition on ``id_col``.  ``low`` and ``high`` are the
    bounds of a negative's score in hundredths of the positive's.
    """
    spark = rows.sparkSession
    clean = usable(rows, id_col, vector, label)
    anchors = usable(rows.where(is_anchor), id_col, vector, label).withColumn("number", F.monotonically_increasing_id())
    dims = clean.agg(F.max(F.size("v"))).first()[0] or 0
    path, done = f"{scratch_dir(spark)}/callmill-negatives-{uuid.uuid4().hex}", []
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dims:
        axes = rotation(moments(clean, dims))
        for block in blocks_of(stage(anchors, "anchors"), max(1, BLOCK_BYTES // (8 * dims))):
            held = block.select("id", "label", "v").orderBy("id").toArrow()
            if not held.num_rows:
                continue
            ids, labels = (held[c].to_numpy() for c in ("id", "label"))
            q = quantized(held["v"].combine_chunks(), dims)
            sent = spark.sparkContext.broadcast((ids, labels, q, axes, None))
            best = positives_of(clean, sent, dims, positives).orderBy("a", "place").toArrow()
            sent.unpersist()
            owner, positive, score = (best[c].to_numpy() for c in ("a", "id", "score"))
            sent = spark.sparkContext.broadcast((ids, labels, q, axes, (owner, score)))
            windows = pa.table({"w": pa.array(np.arange(len(owner))), "anchor_id": pa.array(ids[owner]), "positive_id": pa.array(positive), "positive_score": pa.array(score)})
            found = negatives_of(clean, sent, dims, negatives, low, high).join(spark.createDataFrame(windows).hint("merge"), "w")
            found = found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            done.append(f"{path}/{len(done)}")
            found.write.mode("overwrite").parquet(done[-1])
            sent.unpersist()
    if not done:
        return spark.createDataFrame([], out)
    return spark.read.schema(out).option("recursiveFileLookup", "true").parquet(path)
