"""Folds in chunks against plain loops."""

import random

import pytest

from callmill.operators import folds


def plain_bins(rows, limit):
    out, state = {}, {}
    for who, seq, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        total, at = state.get(who, (0, 0))
        out[who, seq] = at
        total += size or 0
        state[who] = (0, at + 1) if total >= limit else (total, at)
    return out


def plain_admitted(rows, quota):
    out, used, held = {}, {}, {}
    for who, seq, request, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        more = size - held.get((who, request), 0)
        out[who, seq] = used.get(who, 0) + more <= quota
        if out[who, seq]:
            used[who], held[who, request] = used.get(who, 0) + more, size
    return out


KINDS = {
    "random": lambda r: r.randint(0, 40), "zeros": lambda r: 0, "ones": lambda r: 1, "equal": lambda r: 7, "above the limit": lambda r: r.choice([1, 500]), "mostly zero": lambda r: r.choice([0, 0, 0, 0, 30]), "nulls": lambda r: r.choice([None, 3, 9]),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("writers", [["a"], ["a", "b", None]])
def test_bins(spark, kind, writers):
    rng = random.Random(f"{kind}{writers}")
    rows = [(rng.choice(writers), i, KINDS[kind](rng)) for i in range(160)]
    df = spark.createDataFrame(rows, "writer string, seq long, size long").repartition(3)
    for limit in (50, 1) if kind == "random" else (50,):
        got = {(r["writer"], r["seq"]): r["bin"] for r in folds.greedy_bins(df, limit, chunks=9).collect()}
        assert got == plain_bins(rows, limit)
    if writers == ["a"]:
        one = {r["seq"]: r["bin"] for r in folds.greedy_bins(df.drop("writer"), 50, key=None, chunks=9).collect()}
        assert one == {s: b for (_, s), b in plain_bins(rows, 50).items()}


def test_bins_settle_one_after_the_other_where_they_must(spark, monkeypatch):
    monkeypatch.setattr(folds, "ROUNDS", 1)
    rows = [("a", i, 7) for i in range(100)]
    df = spark.createDataFrame(rows, "writer string, seq long, size long")
    assert {(r["writer"], r["seq"]): r["bin"] for r in folds.greedy_bins(df, 50, chunks=6).collect()} == plain_bins(rows, 50)


@pytest.mark.parametrize(("ids", "quota"), [(3, 60), (20, 400), (1000, 400), (20, 0), (3, 100_000)])
def test_admission(spark, ids, quota):
    rng = random.Random(ids * 7 + quota)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), i, f"w{rng.randrange(ids)}", rng.choice([0, 1, 5, 30, rng.randint(0, 60)])) for i in range(150)]
    df = spark.createDataFrame(rows, "writer string, seq long, request_id string, size long").repartition(3)
    got = {(r["writer"], r["seq"]): r["admitted"] for r in folds.admitted(df, quota, chunks=7).collect()}
    assert got == plain_admitted(rows, quota)


def test_whole_chunks_are_decided_at_once(spark, monkeypatch):
    """A writer's rows below the quota, and rows that can't fit, are folded by no task."""
    tables = []
    real = folds.Scratch.table
    monkeypatch.setattr(folds.Scratch, "table", lambda self, df, name, by=(): tables.append(name) or real(self, df, name, by))
    rows = [("a", i, f"w{i}", 10) for i in range(300)]
    df = spark.createDataFrame(rows, "writer string, seq long, request_id string, size long")
    got = {(r["writer"], r["seq"]): r["admitted"] for r in folds.admitted(df, 1005, chunks=12).collect()}
    assert got == plain_admitted(rows, 1005)
    assert tables.count("folded") == 1


def test_empty(spark):
    df = spark.createDataFrame([], "writer string, seq long, request_id string, size long")
    assert folds.greedy_bins(df, 5).count() == 0 and folds.admitted(df, 5).count() == 0
    assert folds.greedy_bins(df, 5).columns == [*df.columns, "bin"] and folds.admitted(df, 5).columns == [*df.columns, "admitted"]
