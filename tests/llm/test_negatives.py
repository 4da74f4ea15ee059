import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmill.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, is_anchor, positives=5, n=10, low=30, high=90):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, y in ok:
        if not is_anchor(i):
            continue
        best = sorted((-dot(v, w), k) for k, w, z in ok if z == y and k != i)[:positives]
        others = sorted((-dot(v, w), k) for k, w, z in ok if z != y)
        for p, k in best:
            fits = [(s, m) for s, m in others if low * -p <= 100 * -s <= high * -p][:n]
            out += [(i, k, at + 1, m, -p, -s) for at, (s, m) in enumerate(fits)]
    return sorted(out)


def got(df, **options):
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(rng, n, dims, kind):
    out = []
    for i in range(n):
        if kind == "alike":
            v = [1.0 + rng.gauss(0, 0.05) for _ in range(dims)]
        elif kind == "few values":
            v = [rng.choice([-0.5, 0.0, 0.5]) for _ in range(dims)]
        else:
            v = [rng.gauss(0, 1) * (0.9**k) for k in range(dims)]
        out.append((i, v, rng.randrange(3)))
    return out


@pytest.mark.parametrize("seed, n, dims, kind", [(1, 300, 16, "falling"), (2, 200, 5, "few values"), (3, 200, 8, "alike"), (4, 120, 1, "falling"), (5, 90, 40, "falling")])
def test_against_all_pairs(spark, seed, n, dims, kind):
    rows = vectors(random.Random(seed), n, dims, kind)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert got(spark.createDataFrame(rows, ROWS).repartition(3)) == want
    assert want or kind == "alike"


def test_blocks_and_slices(spark, monkeypatch):
    """Small blocks and slices give the same rows."""
    rows = vectors(random.Random(6), 150, 12, "falling")
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 12 * 4)
    monkeypatch.setattr(negatives, "PAIRS", 64)
    assert got(spark.createDataFrame(rows, ROWS).repartition(3)) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_edges(spark):
    rng = random.Random(7)
    rows = vectors(rng, 80, 4, "falling")
    rows += [(90, None, 1), (100, [1.0, None, 0.0, 0.0], 1), (110, [float("nan")] * 4, 0), (120, [float("inf"), 0.0, 0.0, 0.0], 0), (130, [1.0, 1.0, 0.0, 0.0], None), (None, [1.0, 1.0, 0.0, 0.0], 1)]
    rows += [(140, [], 0), (150, [0.7], 1), (160, [0.5, 0.5, 0.1, -0.2, 0.9, 0.3], 2)]
    rows += [rows[11], rows[11], (200, rows[0][1], 1), (200, rows[0][1], 1), (20, rows[5][1], 0)]
    df = spark.createDataFrame(rows, ROWS)
    for name in ("id", "v", "a", "w", "score", "rank", "number"):
        df = df.withColumn(name, F.lit("old"))
    assert got(df) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert got(spark.createDataFrame([], ROWS)) == []
    assert got(spark.createDataFrame([(0, [], 1), (1, [], 1)], ROWS)) == []
    assert got(spark.createDataFrame([(i, [0.0, 0.0], i % 2) for i in range(30)], ROWS)) == plain_negatives([(i, [0.0, 0.0], i % 2) for i in range(30)], lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="64 bits"):
        got(spark.createDataFrame([(0, [1e9], 0), (1, [1e9], 0)], ROWS))


def test_bounds_never_miss():
    """Every pair in range survives, and survivors carry exact scores."""
    rng = np.random.default_rng(8)
    for scale in (1, 1000, 1e6):
        q, p = (np.floor(rng.normal(size=(n, 24)) * scale * 0.8 ** np.arange(24)) for n in (20, 300))
        axes = negatives.rotation(p.T @ p)
        a, x = negatives.Turned(q, axes), negatives.Turned(p, axes)
        exact = q.astype(int) @ p.astype(int).T
        low, high = np.quantile(exact, 0.9, axis=1), np.quantile(exact, 0.97, axis=1)
        i, j, s = negatives.survivors(a, x, np.ones(exact.shape, bool), low, high)
        assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero((exact >= low[:, None]) & (exact <= high[:, None])), strict=True))
        assert (s == exact[i, j]).all()


def test_most_pairs_are_discarded_early(monkeypatch):
    rng = np.random.default_rng(9)
    p = np.floor(256 * rng.normal(size=(2000, 64)) * 0.9 ** np.arange(64))
    axes = negatives.rotation(p.T @ p)
    a, x = negatives.Turned(p[:50], axes), negatives.Turned(p, axes)
    exact = p[:50].astype(int) @ p.astype(int).T
    counted = []
    real = np.einsum
    monkeypatch.setattr(negatives.np, "einsum", lambda how, *m: counted.append(len(m[0])) or real(how, *m))
    negatives.survivors(a, x, np.ones(exact.shape, bool), np.quantile(exact, 0.99, axis=1), np.full(50, np.inf))
    assert sum(counted) < 0.1 * exact.size
