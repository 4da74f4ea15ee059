"""Reading and writing the record store and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from .numbered import Files
from .spool import TableSpool

FILES = "day string, request_id string, name string, data string, size long, mtime timestamp"
INDEX = "request_id string, session_key string, timestamp string, project_id_hash string"


def _there(spark: SparkSession, path: str) -> bool:
    return Files(spark, path).exists()


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's record files: a row per ``<day>/<id>.json``.  A missing store is empty; other files are passed over.

    Bodies are read only where a query selects them.
    """
    if not _there(spark, path):
        return spark.createDataFrame([], FILES)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    at = r"/(\d{8})/([^/]+)\.json$"
    rows = files.where(F.col("path").rlike(at))
    return rows.select(
        F.regexp_extract("path", at, 1).alias("day"), F.regexp_extract("path", at, 2).alias("request_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.decode("content", "UTF-8").alias("data"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
    )


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """Index lines (day, line_no, parse_ok and the line's fields) of ``<day>/index.jsonl``; a missing index is empty.

    Files are read in blocks.  line_no rises with the place in the file: the
    block's place, then the line's place in the block.
    """
    if not _there(spark, path):
        return spark.createDataFrame([], f"day string, line_no long, parse_ok boolean, {INDEX}")
    text = spark.read.format("text").option("pathGlobFilter", "index.jsonl").option("recursiveFileLookup", "true").load(path)
    place = F.expr("shiftleft(_metadata.file_block_start DIV 65536, 33)").bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    lines = text.select(F.regexp_extract("_metadata.file_path", r"/(\d{8})/index\.jsonl$", 1).alias("day"), place.alias("line_no"), F.from_json("value", INDEX).alias("e"), "value").where("value <> ''")
    return lines.select("day", "line_no", F.col("e.request_id").isNotNull().alias("parse_ok"), "e.*")


def write_records(records: DataFrame, path: str, written: int) -> None:
    """Add storable records to a store, under the number of this write, which a repetition replaces."""
    TableSpool(records.sparkSession, path).write(records, written)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What a store holds: of each day and id the last write, unless it is delivered or withdrawn."""
    return TableSpool(spark, path).rows()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The facts of stored records, read without their bodies, in the form of ``scan_index``."""
    rows = store.index_lines(read_records(spark, path))
    return rows.select("day", F.lit(0).cast("long").alias("line_no"), F.lit(True).alias("parse_ok"), "request_id", "session_key", F.col("timestamp").cast("string").alias("timestamp"), "project_id_hash")


def read_config_chain(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Settings files with their place in the chain, the first being the strongest."""
    found = None
    for i, p in enumerate(paths):
        if not _there(spark, p):
            continue
        one = spark.read.schema(schema).json(p, multiLine=True).withColumn("place", F.lit(i))
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], f"{schema}, place int")
