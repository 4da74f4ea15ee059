"""The versioned store: withdrawal that reaches the files, crashes, concurrent writers, keyed reads."""

import itertools
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from callmill.operators import delivery
from callmill.sources import numbered, records
from callmill.sources.spool import REJECTED, TableSpool

ROWS = "request_id string, session_key string, timestamp string, project_id_hash string, data string"


def body(i, project):
    return json.dumps({"schema_version": "1", "n": f"body-{i}-{project}", "capture": {"project_id_hash": project}})


def rows(spark, ids, project=lambda i: f"p{i % 3}", day=lambda i: 1 + i % 2, told=lambda i: i % 2 == 0):
    found = [(f"r{i:03d}", "", f"2024-01-0{day(i)}T00:00:00Z", project(i) if told(i) else "", body(i, project(i))) for i in ids]
    return spark.createDataFrame(found, ROWS)


@pytest.fixture
def spool(spark, tmp_path):
    made = TableSpool(spark, f"file://{tmp_path}/store")
    made.write(rows(spark, range(0, 20)), 0)
    made.write(rows(spark, range(20, 30)), 1)
    return made


def ids(df):
    return sorted(int(r["request_id"][1:]) for r in df.select("request_id").collect())


def texts(spool):
    """Everything that any file below the store holds, decoded by Spark or as it is."""
    root = spool.path.removeprefix("file://")
    out = []
    for folder, _, names in os.walk(root):
        for name in names:
            path = f"{folder}/{name}"
            if name.endswith(".parquet"):
                out.append("\n".join(map(str, spool.spark.read.parquet(f"file://{path}").collect())))
            elif not name.endswith(".crc"):
                out.append(open(path, errors="replace").read())
    return "\n".join(out)


def test_purge_reaches_every_file(spark, spool):
    spool.set_aside(spool.rows().where("request_id < 'r006'").withColumns({"batch_id": F.lit("b/1"), "details": F.lit("no")}))
    spool.remove(spool.rows().where("request_id = 'r001'"))
    assert "p1" in texts(spool)
    spool.purge("p1")
    assert ids(spool.rows()) == [i for i in range(30) if i % 3 != 1 and i != 1]
    assert ids(spool.rejected()) == [0, 2, 3, 5]
    assert re.search(r"-p1\b", texts(spool)) is None and '"p1"' not in texts(spool)
    assert spool.vacuum(0) == []


class Crash(Exception):
    pass


def test_a_purge_that_is_cut_short_leaves_the_old_or_the_new_version(spark, tmp_path, monkeypatch):
    for at in itertools.count():
        path = f"file://{tmp_path}/s{at}"
        spool = TableSpool(spark, path)
        spool.write(rows(spark, range(6)), 0)
        spool.set_aside(spool.rows().where("request_id = 'r001'").withColumns({"batch_id": F.lit("b"), "details": F.lit("no")}))
        calls = itertools.count()

        def step(real, calls=calls, at=at):
            def run(*a, **k):
                if next(calls) == at:
                    raise Crash
                return real(*a, **k)

            return run

        broken = TableSpool(spark, path)
        monkeypatch.setattr(broken, "_write", step(broken._write))
        monkeypatch.setattr(broken.log, "append", step(broken.log.append))
        monkeypatch.setattr(broken.log, "forget", step(broken.log.forget))
        monkeypatch.setattr(broken.files, "delete", step(broken.files.delete))
        try:
            broken.purge("p1")
            crashed = False
        except Crash:
            crashed = True
        assert ids(spool.rows()) in ([0, 1, 2, 3, 4, 5], [0, 2, 3, 5])
        assert ids(spool.rejected()) in ([1], [])
        TableSpool(spark, path).purge("p1")
        spool.vacuum(0)
        assert ids(spool.rows()) == [0, 2, 3, 5] and ids(spool.rejected()) == []
        assert '"p1"' not in texts(spool)
        if not crashed:
            assert at > 4
            break


def test_writes_replace_their_keys(spark, spool):
    spool.write(rows(spark, [3, 4], project=lambda i: "new"), 2)
    assert ids(spool.rows()) == list(range(30))
    assert ids(spool.rows().where("data LIKE '%new%'")) == [3, 4]
    spool.write(rows(spark, [4, 40], project=lambda i: "again"), 2)  # the same write again: what it wrote before is gone
    assert ids(spool.rows()) == [i for i in range(30) if i != 3] + [40]
    assert ids(spool.rows().where("data LIKE '%again%'")) == [4, 40]
    spool.sweep()
    assert "-new" not in texts(spool)
    # unchanged folders are not rewritten
    before = {f["at"] for d in spool.manifest()["days"].values() for f in d}
    spool.write(rows(spark, [50]), 3)
    assert before < {f["at"] for d in spool.manifest()["days"].values() for f in d}


def test_of_two_writers_neither_loses_rows(spark, spool):
    other = TableSpool(spark, spool.path)
    real, done = spool.log.append, []

    def late(number, entry):
        if not done:
            done.append(other.write(rows(spark, [60, 61, 5]), 8))
        return real(number, entry)

    spool.log.append = late
    spool.write(rows(spark, [70, 5]), 9)
    assert ids(spool.rows()) == [*range(30), 60, 61, 70]


def test_numbers_are_taken_once(spark, tmp_path):
    log = numbered.Log(spark, f"file://{tmp_path}/log")
    assert log.latest() == (0, None)
    log.append(1, {"a": 1})
    with pytest.raises(numbered.Taken):
        log.append(1, {"a": 2})
    log.append(2, {"a": "é"})
    assert log.latest() == (2, {"a": "é"}) and log.numbers() == [1, 2]
    log.forget(9)
    assert log.numbers() == [2]
    assert [n for n in os.listdir(tmp_path / "log") if n.endswith(".part")] == []


def test_an_entry_is_whole_where_disks_have_no_links(spark, tmp_path):
    log = numbered.Log(spark, f"file://{tmp_path}/log")
    log.append(1, {"a": 1})
    log.files._rename = log.files._renamed(log.files.path("x"))
    log.append(2, {"a": 2})
    with pytest.raises(numbered.Taken):
        log.append(2, {"a": 3})
    assert log.latest() == numbered.Log(spark, log.files.root).latest() == (2, {"a": 2}) and log.numbers() == [1, 2]
    assert [n for n in os.listdir(tmp_path / "log") if n.endswith(".part")] == []


def test_many_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Writes over older rows, a requeue and single rows that left, each with more keys than may be copied to every task, and with few."""
    plans, write = [], TableSpool._write

    def watched(self, found, folder, **options):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return write(self, found, folder, **options)

    monkeypatch.setattr(TableSpool, "_write", watched)
    for most in (5, 50):
        monkeypatch.setattr("callmill.sources.spool.FEW_ROWS", most)
        del plans[:]
        spool = TableSpool(spark, f"file://{tmp_path}/{most}")
        spool.write(rows(spark, range(20)), 0)
        spool.write(rows(spark, range(8, 30)), 1)
        assert ids(spool.rows()) == [*range(30)]
        aside = spool.rows().where("request_id < 'r012'").withColumns({"batch_id": F.lit("b"), "details": F.lit("no")})
        spool.set_aside(aside)
        spool.remove(aside)
        plans.append(spool.rows()._jdf.queryExecution().executedPlan().toString())
        assert ids(spool.rows()) == [*range(12, 30)]
        assert spool.requeue("b") == 12 and ids(spool.rows()) == [*range(30)]
        joins = [p for p in plans if "Join" in p]
        assert len(joins) == 3  # the write, the rows that left and the requeue
        assert all(("Broadcast" in p) == (most == 50) for p in joins)


def test_requeue_and_discard(spark, spool):
    aside = spool.rows().where("request_id < 'r006'").withColumns({"batch_id": F.when(F.col("request_id") < "r004", "one").otherwise("two"), "details": F.lit("no")})
    aside = aside.withColumn("data", F.when(F.col("request_id") == "r002", "{").otherwise(F.col("data")))
    for _ in range(2):
        spool.set_aside(aside)  # a repetition replaces
    spool.remove(aside)
    assert (ids(spool.rejected()), ids(spool.rows())) == ([0, 1, 2, 3, 4, 5], list(range(6, 30)))
    assert spool.requeue("one") == 3
    assert (ids(spool.rejected()), ids(spool.rows())) == ([2, 4, 5], [0, 1, 3, *range(6, 30)])
    assert spool.rejected("one").first()["data"] == "{"
    assert spool.requeue("none") == 0
    assert spool.discard("two") == 2 and spool.discard("two") == 0
    assert ids(spool.rejected()) == [2] and "body-4-" not in "".join(r["data"] for r in spool.rejected().collect())
    spool.compact()
    spool.sweep()
    assert "body-4-" not in texts(spool)


def test_compaction_and_vacuum(spark, spool):
    spool.remove(spool.rows().where("request_id < 'r010'"))
    ranges = spark.createDataFrame([("b", "20240101", "r009", "r015"), ("b", "20240102", "", "r012")], "batch_id string, day string, after string, last string")
    _, version = spool.snapshot()
    spool.pin(ranges, version)
    spool.compact()
    assert len(spool.manifest()["days"]["20240101"]) == 2  # not while a batch is on its way
    assert ids(spool.batches(("b",))) == [10, 11, 12, 14]
    spool.write(rows(spark, [10], project=lambda i: "later"), 5)  # what comes later stays
    assert ids(spool.batches(("b",))) == [11, 12, 14]
    spool.settle("b")
    spool.settle("b")
    assert ids(spool.rows()) == [10, 13, *range(15, 30)]
    spool.compact()
    m = spool.manifest()
    assert (m["gone"], m["withdrawn"], [len(f) for f in m["days"].values()]) == ({}, [], [1, 1])
    assert ids(spool.rows()) == [10, 13, *range(15, 30)]
    spark.range(1).write.parquet(f"{spool.path}/records/leftover")
    assert spool.vacuum(3600) == [] or "records/leftover" not in spool.vacuum(3600)
    assert "records/leftover" in spool.vacuum(0)
    assert "body-3-" not in texts(spool) and ids(spool.rows()) == [10, 13, *range(15, 30)]


def test_ranges_of_one_flush_merge(spark, spool):
    stored, version = spool.snapshot()
    ranges = delivery.batch_ranges(delivery.cut_batches(stored, 300)).withColumn("batch_id", F.concat(F.lit("b"), F.lpad(F.col("bin").cast("string"), 3, "0")))
    held = ranges.toPandas()
    batches = sorted(set(held["batch_id"]))
    assert len(batches) > 5
    for b in batches:
        spool.pin(ranges.where(F.col("batch_id") == b).select("batch_id", "day", "after", "last"), version)
        assert spool.batches((b,)).agg(F.sum("size")).first()[0] >= min(300, 1)
        spool.settle(b)
    assert spool.rows().count() == 0
    assert {d: len(r) for d, r in spool.manifest()["gone"].items()} == {"20240101": 1, "20240102": 1}


def test_a_batch_is_read_by_filters_alone(spark, spool):
    """No exchange, no window, and the ids' bounds reach the scan."""
    _, version = spool.snapshot()
    spool.pin(spark.createDataFrame([("b", "20240102", "r003", "r011")], "batch_id string, day string, after string, last string"), version)
    found = spool.batches(("b",))
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Exchange" not in plan and "Window" not in plan
    assert re.search(r"PushedFilters: .*GreaterThan\(request_id,r003\).*LessThanOrEqual\(request_id,r011\)", plan)
    assert "of_day=20240102" in plan and "of_day=20240101" not in plan
    assert ids(found) == [5, 7, 9, 11]


def test_random_histories(spark, tmp_path):
    """Against a dictionary."""
    rng = random.Random(3)
    spool, want = TableSpool(spark, f"file://{tmp_path}/h"), {}
    for n in range(14):
        what = rng.choice(["write", "write", "remove", "purge", "compact", "sweep"])
        if what == "write":
            chosen, project = rng.sample(range(15), rng.randint(1, 6)), f"p{rng.randint(0, 2)}"
            spool.write(rows(spark, chosen, project=lambda i, p=project: p), n)
            want |= dict.fromkeys(chosen, project)
        elif what == "remove":
            gone = rng.sample(range(15), 3)
            spool.remove(spool.rows().where(F.col("request_id").isin([f"r{i:03d}" for i in gone])))
            want = {i: p for i, p in want.items() if i not in gone}
        elif what == "purge":
            spool.purge("p1")
            want = {i: p for i, p in want.items() if p != "p1"}
        else:
            getattr(spool, what)()
        assert {int(r["request_id"][1:]): r["data"].split("-")[2].split('"')[0] for r in spool.rows().collect()} == want


def test_empty_stores(spark, tmp_path):
    spool = TableSpool(spark, f"file://{tmp_path}/none")
    assert spool.rows().count() == 0 and spool.rejected().count() == 0 and spool.batches(("b",)).count() == 0
    spool.write(rows(spark, []), 0)
    spool.purge("p")
    spool.compact()
    assert spool.requeue("b") == spool.discard("b") == 0
    assert spool.rows().columns == [c.split()[0] for c in records.TableSpool(spark, spool.path).rows().columns]
    assert spool.rejected().columns == [c.split()[0] for c in REJECTED.split(", ")]
