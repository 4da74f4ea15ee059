"""The record store: a table partitioned by day, and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from .envelope import lenient_project_hash


def storable(records: DataFrame) -> DataFrame:
    """Rows with a safe id and a timestamp, with day and size."""
    at = policy.parse_instant(F.col("timestamp"))
    rows = records.where(F.col("request_id").rlike(policy.ID_PATTERN)).withColumn("ts", at).where("ts IS NOT NULL")
    return rows.withColumns({"day": policy.day_key(F.col("ts")), "size": F.octet_length("data").cast("long")})


def last_write(rows: DataFrame, order: str) -> DataFrame:
    """Of writes with the same day and id, the last stays."""
    latest = Window.partitionBy("day", "request_id").orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def index_lines(rows: DataFrame) -> DataFrame:
    """The facts of stored records that can be read without their bodies."""
    return rows.select("day", "request_id", "session_key", "timestamp", "project_id_hash")


def latest_index(index: DataFrame) -> DataFrame:
    """Readable index lines, the last of each day and id."""
    good = index.where("parse_ok AND request_id IS NOT NULL")
    latest = Window.partitionBy("day", "request_id").orderBy(F.col("line_no").desc())
    return good.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "parse_ok", "line_no")


def with_index(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files are authoritative; a time that the index lacks is the file's own."""
    known = latest_index(index).select("day", "request_id", "session_key", F.col("timestamp").alias("_at"), "project_id_hash")
    rows = files.join(known, ["day", "request_id"], "left")
    return rows.withColumns({"timestamp": F.coalesce(policy.parse_instant(F.col("_at")), F.col("mtime")), "session_key": F.coalesce("session_key", F.lit(""))}).drop("_at")


def rewrite_index(index: DataFrame, removed: DataFrame) -> DataFrame:
    """Index lines without the removed ids; lines that can't be read stay as they are."""
    return index.where("NOT parse_ok").unionByName(index.where("parse_ok").join(removed.select("day", "request_id").distinct(), ["day", "request_id"], "left_anti").select(index.columns))


def delete_acknowledged(spool: DataFrame, acked: DataFrame) -> DataFrame:
    """By id, whatever the day."""
    return spool.join(acked.select("request_id").distinct(), "request_id", "left_anti").select(spool.columns)


def attributed(spool: DataFrame, index: DataFrame) -> DataFrame:
    """Adds owner: the index's project, else the body's.  Bodies are read only where the index has none."""
    known = latest_index(index).select("day", "request_id", F.nullif("project_id_hash", F.lit("")).alias("_own"))
    rows = spool.join(known, ["day", "request_id"], "left")
    sure = rows.where("_own IS NOT NULL").withColumn("owner", F.col("_own"))
    unsure = rows.where("_own IS NULL").withColumn("owner", lenient_project_hash(F.col("data")))
    return sure.unionByName(unsure).select(*spool.columns, "owner")


def purge_project(spool: DataFrame, index: DataFrame, project: str) -> DataFrame:
    """Without the project's rows; rows of unknown projects stay."""
    return attributed(spool, index).where(~F.col("owner").eqNullSafe(F.lit(project))).drop("owner")


def purge_quarantine(rejected: DataFrame, project: str) -> DataFrame:
    return rejected.where(~lenient_project_hash(F.col("data")).eqNullSafe(F.lit(project)))


# ---- accounting

def usage(files: DataFrame) -> DataFrame:
    """Bytes of all files, index files included."""
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def day_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("day").agg(F.count_if(F.col("name").endswith(".json")).alias("records"), F.sum("size").alias("bytes"))


def oldest(rows: DataFrame) -> DataFrame:
    """The earliest time within the first day that has rows."""
    first = rows.agg(F.min("day").alias("day"))
    return rows.join(F.broadcast(first), "day", "left_semi").groupBy("day").agg(F.min("timestamp").alias("oldest"))
