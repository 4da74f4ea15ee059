"""The store as a data source: conditions, streams with a restart in the middle, acknowledgements."""

import os
import random

import pytest
from pyspark.sql import functions as F

from callmill.sources import source
from callmill.sources.spool import RECORDS, TableSpool

from .test_store_versions import ids, rows


@pytest.fixture
def spool(spark, tmp_path):
    source.register(spark)
    made = TableSpool(spark, f"file://{tmp_path}/store")
    made.write(rows(spark, range(0, 20)), 0)
    made.write(rows(spark, range(20, 30)), 1)
    return made


def read(spark, spool):
    return spark.read.format(source.STORE).load(spool.path)


def same(one, two):
    columns = [c.split()[0] for c in RECORDS.split(", ")]
    assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, two.select(columns).collect()))


def test_reads_what_the_store_holds(spark, spool):
    same(read(spark, spool), spool.rows())
    spool.remove(spool.rows().where("request_id IN ('r001', 'r004', 'r025')"))
    spool.pin(spark.createDataFrame([("b", "20240101", "r000", "r010")], "batch_id string, day string, after string, last string"), spool.snapshot()[1])
    spool.settle("b")
    spool.write(rows(spark, [4, 6]), 2)  # written again after it was let go of
    same(read(spark, spool), spool.rows())
    assert 4 in ids(read(spark, spool)) and 8 not in ids(read(spark, spool)) and 25 not in ids(read(spark, spool))
    spool.compact()
    same(read(spark, spool), spool.rows())


def test_small_files_make_several_tasks():
    """Files of packed rows cost more than their bytes tell: few of them are a task, and none is left out."""
    parts = [source.Part(f"f{i}", 1 << 20, "20240101", [], [], [], None) for i in range(14)]
    tasks = source._tasks(parts)
    assert len(tasks) >= 3 and [p for t in tasks for p in t.parts] == parts
    large = source.Part("large", 1 << 30, "20240101", [], [], [], None)
    assert [len(t.parts) for t in source._tasks([large, *parts[:2], large])] == [1, 2, 1]


def test_empty_and_missing_stores(spark, tmp_path):
    source.register(spark)
    assert spark.read.format(source.STORE).load(f"file://{tmp_path}/none").count() == 0
    assert source.acknowledged(spark, f"file://{tmp_path}/none").count() == 0


def test_conditions_are_answered_by_the_reader(spark, spool):
    rng, day, key = random.Random(3), F.col("day"), F.col("request_id")
    tests = [day == "20240101", day >= "20240102", day.isin("20240101", "x"), key == "r007", key < "r010", key.isin("r001", "r021"), key > "r015", F.lit("r003") <= key, F.length("data") > 10, key.like("%5")]
    for _ in range(6):
        a, b = rng.sample(tests, 2)
        same(read(spark, spool).where(a & b), spool.rows().where(a & b))
    fs, root = source._open(spool.path)
    m = spool.manifest()
    every, one = source._parts(fs, root, m, []), source._parts(fs, root, m, [(source.api.EqualTo, "day", "20240102")])
    assert {p.day for p in every} == {"20240101", "20240102"} and {p.day for p in one} == {"20240102"}
    narrow = spark.read.format(source.STORE).schema("request_id string, size long").load(spool.path)
    assert narrow.columns == ["request_id", "size"] and narrow.count() == 30


def stream(spark, spool, folder, **options):
    found = spark.readStream.format(source.STORE).options(**options).load(spool.path)
    query = found.writeStream.format(source.PARTS).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start(f"{folder}/sink")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return source.acknowledged(spark, f"{folder}/sink")


@pytest.mark.parametrize("options", [{}, {"bytes_per_batch": "1", "reader": "one"}])
def test_stream_restarts_in_the_middle(spark, spool, tmp_path, options):
    folder = f"file://{tmp_path}/out"
    assert ids(stream(spark, spool, folder, **options)) == list(range(30))
    spool.write(rows(spark, range(30, 40)), 2)
    spool.remove(spool.rows().where("request_id = 'r003'"))
    spool.compact()  # moves rows that were read already
    spool.write(rows(spark, range(40, 45)), 3)
    spool.write(rows(spark, range(45, 50)), 4)
    assert ids(stream(spark, spool, folder, **options)) == list(range(50))
    assert ids(stream(spark, spool, folder, **options)) == list(range(50))
    batches = len([n for n in os.listdir(f"{tmp_path}/out/sink/acknowledged") if n.endswith(".json")])
    assert batches >= 5 if options else batches >= 2
    spool.remove(source.acknowledged(spark, f"{folder}/sink"))
    assert spool.rows().count() == 0


def test_bounded_stream_needs_a_name():
    with pytest.raises(ValueError, match="reader"):
        source.StoreStream({"path": "x", "bytes_per_batch": "5"}, None)


def test_a_repeated_commit_leaves_one_copy(spark, tmp_path):
    schema = source.pa.schema([("request_id", source.pa.string())])
    writer, sink = source.PartsWriter(str(tmp_path), schema), f"file://{tmp_path}"
    batch = source.pa.RecordBatch.from_pydict({"request_id": ["a", "b"]}, schema=schema)
    first, second, third = (writer.write(iter([batch])) for _ in range(3))
    assert source.acknowledged(spark, sink, "request_id string").count() == 0  # nothing names them yet
    writer.abort([first, None], 0)
    writer.commit([second, None], 0)
    writer.commit([third], 0)
    assert os.listdir(tmp_path / "parts") == [second.part]
    assert source.acknowledged(spark, sink, "request_id string").count() == 2
    assert source.acknowledged(spark, sink, "request_id string", after=0).count() == 0
    writer.commit([writer.write(iter([]))], 1)  # an empty micro-batch is acknowledged too
    assert source.acknowledged(spark, sink, "request_id string").count() == 2
