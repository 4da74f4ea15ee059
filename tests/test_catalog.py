import duckdb
import pytest
from pyspark.sql import functions as F

from callmill.functions import policy
from callmill.plans import catalog, scenarios  # noqa: F401  scenarios adds its queries to the catalogue

from .compare import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, name):
    want = connect(SF).execute(catalog.ORACLE_SQL[name]).df()
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(want)


def test_crash_window_counts_whole_seconds_that_have_begun(spark, tmp_path):
    """A day after the first crash, but for a fraction that a rounded time would count as a second more."""
    times = ["2024-01-01 00:00:00.4", "2024-01-01 12:00:00", "2024-01-02 00:00:00.6"]
    duckdb.sql("SELECT unnest(range(3)) AS event_id, 7 AS user_id, unnest(%s)::TIMESTAMP AS ts" % times).write_parquet(f"{tmp_path}/events.parquet")
    want = connect(str(tmp_path)).execute(catalog.ORACLE_SQL["crash_window"]).df()
    assert rows(catalog.QUERIES["crash_window"](spark, str(tmp_path)).toPandas()) == rows(want)
    assert want.sort_values("event_id")["gave_up"].tolist() == [False, False, True]


def test_human_bytes_of_ties_and_large_keys(spark, tmp_path):
    """Sizes that lie between two tenths, and orders whose sizes reach the units above GiB."""
    duckdb.sql("SELECT unnest([4, 12, 20, 28, 1004, 9_000_000, 36_000_000, 40_000_000_000]::BIGINT[]) AS o_orderkey").write_parquet(f"{tmp_path}/orders.parquet")
    want = connect(str(tmp_path)).execute(catalog.ORACLE_SQL["human_bytes"]).df()
    assert rows(catalog.QUERIES["human_bytes"](spark, str(tmp_path)).toPandas()) == rows(want)
    sizes = {1280: "1.2 KiB", 1792: "1.8 KiB", (1 << 60) * 5 // 4: "1.2 EiB", (1 << 60) * 7 // 4: "1.8 EiB", (1 << 63) - 1: "8.0 EiB", 1048575: "1024.0 KiB"}
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", policy.human_bytes(F.col("n")).alias("text")).collect()
    assert {r["n"]: r["text"] for r in got} == sizes


def test_delivery_history_of_several_batches(spark, monkeypatch):
    """More records than one batch takes: all batches are acknowledged after the first one was requeued."""
    n, limit = spark.read.parquet(f"{SF}/customer.parquet").count(), 22 * 60 - 5
    monkeypatch.setattr(policy, "FLUSH_BYTES", limit)
    want = connect(SF).execute(scenarios._history_sql(limit)).df()
    assert len(want) == 3 + -(-n // 60) and want["records"].sum() == n
    assert rows(catalog.QUERIES["delivery_history"](spark, SF).toPandas()) == rows(want)


@pytest.mark.parametrize("name", ["service_details", "json_payload_mask"])
def test_rows_of_a_small_file_are_dealt_among_tasks(spark, name):
    """One file with one row group, whose rows take long."""
    found = catalog.QUERIES[name](spark, SF).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(found) > spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in found) < sum(r["count"] for r in found) / 2
