"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a vector of document statistics (lengths, shares of kinds of
characters, repetition of words and lines).  Standardized, it is mapped to
``FEATURES`` random cosines, whose inner products approximate a Gaussian
kernel.  Tasks add up the normal equations of their labelled rows; the sums
of partitions are added by Spark, and the driver gets one matrix of a size
that ``FEATURES`` fixes.  The ridge scores of labelled rows that took no part
in the fit are counted in ``BINS`` bins, and pooling adjacent violators gives
the calibration.  A score is 98 parts of the calibrated value and 2 parts of
the ridge score, cut to 0 to 1, which orders documents of one flat stretch.

All labelled rows are used; nothing is sampled.  The statistics are written
once and reread by the fit and by the scoring.

Null and empty texts have statistics of 0 and get a score like any other.
Equal texts get equal scores, in batches of any size and in every run.  A
document that has several labels counts with each.  Null labels are left out.
An empty table gives an empty result; without labels of both classes there is
nothing to learn from a table that has rows, which is an error.
Only ids, texts and labels are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage, with_python_columns

FEATURES, WIDTH, RIDGE, SEED, BINS = 192, 3.0, 1.0, 3, 400
#: Groups in which the sums of partitions are added up first.
FAN_IN = 64
#: Features are rounded to 1 / UNIT before they are added up; sums of 2^31 rows fit into 64 bits.
UNIT = float(1 << 16)

_KINDS = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "space": [32, 9, 11, 12, 13], "line": [10],
    "stop": [*b".,;:?'\"-()"], "shout": [33], "bar": [124], "mark": [*b"*#$%&@^~_+=<>{}[]\\/`"], "high": [*range(128, 256)],
}
_TABLE = np.zeros((256, len(_KINDS)))
for _i, _bytes in enumerate(_KINDS.values()):
    _TABLE[_bytes, _i] = 1
N_STATS = len(_KINDS) + 9


def statistics(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    out = np.zeros(N_STATS)
    if not data:
        return out
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE / len(data)
    k = len(shares)
    out[:k] = np.sqrt(shares)
    words = data.lower().split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, distinct = len(words), Counter(words)
    out[k] = np.log1p(len(data))
    out[k + 1] = np.log1p(n)
    if n:
        out[k + 2] = np.log1p(len(data) / n)
        out[k + 3] = len(distinct) / n
        out[k + 4] = np.log(max(len(distinct), 1)) / np.log1p(n)
        out[k + 5] = np.sqrt(max(distinct.values()) / n)
        pairs = set(zip(words, words[1:], strict=False))
        out[k + 6] = len(pairs) / max(1, n - 1)
    if lines:
        out[k + 7] = len(set(lines)) / len(lines)
        out[k + 8] = np.log1p(len(data) / len(lines))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        out = np.zeros(len(stats))
        # feature by feature, so that a row's sum does not depend on the rows beside it, as a matrix product's would
        for column, weight in zip(fourier(stats, self.mean, self.scale).T, self.weights, strict=True):
            out += column * weight
        return out

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Between 0 and 1; a small share of the raw score keeps the order inside flat stretches."""
        raw = self.raw(stats)
        return np.clip(0.98 * np.interp(raw, self.steps_x, self.steps_y) + 0.02 * np.clip(raw, 0, 1), 0, 1)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features, and a constant; each row's the same whatever the rows beside it."""
    rng = np.random.default_rng(SEED)
    w, b = rng.standard_normal((stats.shape[1], FEATURES)) / WIDTH, rng.random(FEATURES) * 2 * np.pi
    x, angle = np.clip((stats - mean) / scale, -8, 8), np.tile(b, (len(stats), 1))
    for column, direction in zip(x.T, w, strict=True):
        angle += column[:, None] * direction
    return np.concatenate([np.cos(angle) * np.sqrt(2 / FEATURES), np.ones((len(stats), 1))], 1)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and rates of the blocks, by ascending x."""
    blocks: list[list[float]] = []
    for xi, g, k in zip(x, good, n, strict=True):
        blocks.append([xi * k, g, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its column ``text`` replaced by ``stats``, an array of statistics."""
    return with_python_columns(docs, [text], lambda texts: [[statistics(t) for t in texts]], [("stats", T.ArrayType(T.DoubleType()))], drop=(text,))


def _stacked(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, N_STATS)


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all ``rows`` (stats, y), with features in whole units of 1 / ``UNIT``: sums of integers, the same in any order."""
    size = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((size, size + 1), np.int64), False
        for batch in slices(batches, 4096):
            if batch.num_rows:
                any_rows = True
                z = np.rint(fourier(_stacked(batch.column(0)), mean, scale) * UNIT)
                # whole numbers far below 2^53, so the product of doubles is exact
                total += (z.T @ np.column_stack([z, batch.column(1).to_numpy(zero_copy_only=False) * UNIT])).astype(np.int64)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), pa.array(list(total), pa.list_(pa.int64()))], names=["row", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.array(v, np.int64) for v in table["v"].to_pylist())
        return pa.table({"row": table["row"][:1], "v": pa.array([total], pa.list_(pa.int64()))})

    schema = "row long, v array<long>"
    sums = rows.select("stats", "y").mapInArrow(partial, schema).groupBy("row", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).applyInArrow(lambda table: add(table), schema)
    out = np.zeros((size, size + 1))
    for r in sums.groupBy("row").applyInArrow(lambda table: add(table), schema).collect():
        out[r["row"]] = r["v"]
    out /= UNIT**2
    return out[:, :size], out[:, size]


def train(rows: DataFrame) -> Model:
    """``rows`` (stats, y, calibrate): the rows to calibrate by take no part in the fit."""
    rows = rows.where(F.col("y").isin(0, 1)).withColumn("y", F.col("y").cast("double"))
    parts = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = rows.agg(F.count_distinct("y").alias("classes"), *parts).first()
    if found["classes"] < 2:
        raise ValueError("labels of both classes are needed")
    # rounded, as sums of doubles depend on their order in the last digits
    mean = np.round([found[f"m{i}"] for i in range(N_STATS)], 9)
    scale = np.maximum(np.round([found[f"s{i}"] for i in range(N_STATS)], 9), 1e-3)
    a, b = normal_equations(rows.where("NOT calibrate"), mean, scale)
    model = Model(mean, scale, np.linalg.solve(a + RIDGE * np.eye(len(a)), b), np.zeros(1), np.zeros(1))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            raw = model.raw(_stacked(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, -0.5, 1.5) * BINS / 2).astype(np.int64)), batch.column(1)], names=["bin", "y"])

    bins = rows.where("calibrate").select("stats", "y").mapInArrow(spread, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    # half a row of either class at the ends keeps the scores off 0 and 1
    x = np.array([-0.5, *((r["bin"] + 0.5) * 2 / BINS for r in bins), 1.5])
    model.steps_x, model.steps_y = isotonic(x, np.array([0.0, *(r["good"] for r in bins), 0.5]), np.array([0.5, *(r["n"] for r in bins), 0.5]))
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``stats`` with score and predicted in place of its statistics."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def make(rows: list) -> list:
        found = sent.value.score(np.array(rows, float).reshape(-1, N_STATS))
        return [found, (found >= threshold).astype(np.int32)]

    return with_python_columns(stats, ["stats"], make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], drop=("stats",), rows=4096)


def quality(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """id, score and predicted of every document; ``learn`` is a condition on the id."""
    if docs.isEmpty():
        return docs.select(F.col(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    stats = stage(with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(learn(F.col("id")))
    rows = stage(stats.join(known, "id").withColumn("calibrate", F.pmod(F.crc32(F.concat(F.lit("calibrate:"), F.col("id").cast("string"))), F.lit(5)) == 0), "labelled")
    return score(stats, train(rows), threshold).withColumnRenamed("id", id_col)
