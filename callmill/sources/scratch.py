"""Tables in between, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where that is unset, a local master gets a temporary folder, and a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="callmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """A folder of tables that are written once and read back, which cuts their lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/callmill-{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        at = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
