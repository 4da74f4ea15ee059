"""The state of delivery as a log in the shared folder.

Each transition is an entry of its own, under the next number.  A number is
given once, so of two drivers that deliver from one store the one that was
overtaken can't go on (``Fenced``); the machine that a driver runs on may be
lost, its state is not.  Older entries are rolled up into a table, from which,
with the entries since then, ``history`` gives every receipt, error and
rejection.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.delivery import State
from .numbered import Files, Log, Taken

ENTRY = (
    "number long, writer string, state struct<pending array<string>, not_before double, timeouts long, upgrade_required boolean, min_client_version string, last_error string, last_attempt double, "
    "last_upload double, last_rejected string, receipt struct<batch_id string, records long, bytes long, at double>, closed boolean>"
)


class Fenced(Exception):
    """Another driver has gone on from the state that this one had."""


class DeliveryLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log, self.writer, self.at = spark, path, Log(spark, f"{path}/entries"), uuid.uuid4().hex, 0

    def load(self) -> State:
        """The latest state, from which this driver goes on.  An entry that can't be read is set aside, and the one before it counts."""
        while numbers := self.log.numbers():
            try:
                raw = self.log.get(numbers[-1])["state"]
                state = State(**raw | {"pending": tuple(raw["pending"])})
            except (ValueError, TypeError, KeyError):
                name = f"{numbers[-1]:012d}.json"
                self.log.files.fs.rename(self.log.files.path(name), self.log.files.path(f"{name}.unreadable"))
                continue
            self.at = numbers[-1]
            return state
        self.at = 0
        return State()

    def save(self, state: State) -> None:
        """The next entry."""
        try:
            self.log.append(self.at + 1, {"number": self.at + 1, "writer": self.writer, "state": asdict(state)})
        except Taken as e:
            raise Fenced(f"entry {self.at + 1} is another driver's") from e
        self.at += 1

    def entries(self) -> DataFrame:
        """All entries since the last roll, and those that it rolled up."""
        files = Files(self.spark, self.path)
        found = self.spark.read.schema(ENTRY).json(f"{self.path}/entries/*.json") if self.log.numbers() else self.spark.createDataFrame([], ENTRY)
        return found.unionByName(self.spark.read.schema(ENTRY).parquet(f"{self.path}/rolled")) if files.exists("rolled") else found

    def roll(self, keep: int = 100) -> None:
        """Entries but for the last ``keep`` become rows of one table.  A roll that is cut short may leave an entry in both, which ``history`` counts once."""
        numbers = self.log.numbers()
        old = [n for n in numbers if n <= numbers[-1] - keep] if numbers else []
        if old:
            self.spark.read.schema(ENTRY).json([f"{self.path}/entries/{n:012d}.json" for n in old]).coalesce(1).write.mode("append").parquet(f"{self.path}/rolled")
            self.log.forget(old[-1] + 1)

    def history(self) -> DataFrame:
        """number, kind (receipt, error or rejection), batch_id, records, bytes and text of every transition that brought one."""
        rows = self.entries().dropDuplicates(["number"])
        before = Window.orderBy("number")  # a row per attempt of one device's delivery
        state = rows.select("number", "state.*").withColumns({"_receipt": F.lag("receipt.batch_id").over(before), "_rejected": F.lag("last_rejected", 1, "").over(before), "_error": F.lag("last_error", 1, "").over(before), "_attempt": F.lag("last_attempt").over(before)})
        none = F.lit(None)
        kinds = F.array(
            F.when(F.col("receipt.batch_id").isNotNull() & ~F.col("receipt.batch_id").eqNullSafe(F.col("_receipt")), F.struct(F.lit("receipt").alias("kind"), F.col("receipt.batch_id").alias("batch_id"), F.col("receipt.records").alias("records"), F.col("receipt.bytes").alias("bytes"), F.lit("").alias("text"))),
            F.when((F.col("last_rejected") != "") & (F.col("last_rejected") != F.col("_rejected")), F.struct(F.lit("rejection").alias("kind"), F.substring_index("last_rejected", ":", 1).alias("batch_id"), none.cast("long").alias("records"), none.cast("long").alias("bytes"), F.col("last_rejected").alias("text"))),
            F.when((F.col("last_error") != "") & ((F.col("last_error") != F.col("_error")) | ~F.col("last_attempt").eqNullSafe(F.col("_attempt"))), F.struct(F.lit("error").alias("kind"), none.cast("string").alias("batch_id"), none.cast("long").alias("records"), none.cast("long").alias("bytes"), F.col("last_error").alias("text"))),
        )
        return state.select("number", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k")).select("number", "k.*")
