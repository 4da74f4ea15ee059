"""Records to bounded, session-adjacent, compressed batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy, redaction
from . import envelope


def batch_order(rows: DataFrame) -> DataFrame:
    """Adds position within the batch: sessions together, records without one last, then by time and id.

    A session key that the index lost is taken from the body.
    """
    order = [F.col("session_key") == "", "session_key", "timestamp", "nanos", "request_id"]
    key = F.coalesce(F.nullif("session_key", F.lit("")), envelope.session_key(F.get_json_object("data", "$.request")))
    nanos = F.col("nanos") if "nanos" in rows.columns else F.lit(0)
    keyed = rows.withColumns({"session_key": key, "nanos": nanos})
    return keyed.withColumn("position", F.row_number().over(Window.partitionBy("batch_id").orderBy(*order)) - 1)


def record_offsets(rows: DataFrame) -> DataFrame:
    """Adds offset: the bytes of the batch's records before this one."""
    before = Window.partitionBy("batch_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def masked(rows: DataFrame, categories: tuple[str, ...] = (redaction.EMAIL, redaction.PHONE)) -> DataFrame:
    """Masked rows with their index facts and what orders them (session_key, at, nanos); facts of the record override those of the row."""
    key = F.coalesce(F.nullif("session_key", F.lit("")), envelope.session_key(F.get_json_object("data", "$.request")))
    nanos = F.col("nanos") if "nanos" in rows.columns else F.lit(0)
    keyed = rows.withColumns({"session_key": key, "nanos": nanos})
    facts = envelope.parsed(keyed.withColumn("data", redaction.mask_records(F.col("data"), categories)).withColumn("size", F.octet_length("data").cast("long")))
    c = "record.capture."
    return facts.select(
        "batch_id", "request_id", "session_key", "data", "size", "parse_error", "nanos", F.col("timestamp").alias("at"),
        F.coalesce(F.nullif(F.col(c + "project_id_hash"), F.lit("")), F.col("project_id_hash")).alias("project_id_hash"),
        F.col(c + "upstream_origin").alias("upstream_origin"), F.col("record.endpoint").alias("endpoint"),
        F.when(policy.parse_instant(F.col(c + "timestamp")).isNotNull(), F.col(c + "timestamp")).otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        F.coalesce(F.col(c + "garbled"), F.lit(False)).alias("garbled"),
    )


_ORDER = ["session_key = ''", "session_key", "at", "nanos", "request_id"]


def masked_batches(rows: DataFrame, categories: tuple[str, ...] = (redaction.EMAIL, redaction.PHONE)) -> DataFrame:
    """``masked`` rows with position and offset, each batch in one task."""
    position = F.row_number().over(Window.partitionBy("batch_id").orderBy(*map(F.expr, _ORDER))) - 1
    return record_offsets(masked(rows, categories).withColumn("position", position)).drop("at", "nanos")


def placed(rows: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``masked`` rows with position and offset, by ranges of the order: a batch may take many tasks.

    ``hold`` writes and reads back.  Of each range only counts and sums meet
    those of the others.
    """
    order = [F.col("batch_id"), *map(F.expr, _ORDER)]
    held = hold(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("batch_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = held.groupBy("batch_id", "_range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    starts = ends.select("batch_id", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("batch_id", "_range").orderBy(*order[1:])
    found = held.join(F.broadcast(starts), ["batch_id", "_range"])  # a row per range and batch
    position, offset = F.row_number().over(own) - 1, F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumns({"position": position + F.col("_first"), "offset": offset + F.col("_start")}).drop("_range", "_first", "_start", "at", "nanos")


ITEM = ["request_id", "project_id_hash", "upstream_origin", "endpoint", "timestamp", "garbled", "offset", "size"]
#: Bytes of records from which on a batch has a further part; a part ends with the record that reaches them.
PART_BYTES = 8 << 20
PACKED = "batch_id string, envelope string, records binary, n_records long, records_size long, part long, start long"


def pack_batches(rows: DataFrame, client_version: str, created_at: str, run: Callable[[str], dict] = lambda batch_id: {}) -> DataFrame:
    """One row per batch: its envelope and its records, concatenated without separators and compressed.

    A batch of more than ``PART_BYTES`` has several rows, by part, as no task
    could hold it: its items are those of all parts, with offsets in the whole
    batch, and its records are the parts' frames one after the other.  ``start``
    is the offset of a part's first byte.  ``run`` gives what is to be told
    about a batch's run.
    """

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        items = [
            {k: (v.item() if hasattr(v, "item") else v) for k, v in zip(ITEM, r, strict=True) if k in ("request_id", "offset", "size") or (v and v == v)}
            for r in group[ITEM].itertuples(index=False)
        ]
        plain = "".join(group["data"]).encode()
        head = {"schema_version": "1", "batch_id": key[0], "client_version": client_version, "created_at": created_at, "compression": "zstd", "records_size": len(plain), "records": items, "run": run(key[0])}
        packed = zstandard.ZstdCompressor(level=3).compress(plain)
        return pd.DataFrame([(key[0], json.dumps(head, separators=(",", ":")), packed, len(group), len(plain), key[1], items[0]["offset"])], columns=[c.split()[0] for c in PACKED.split(", ")])

    return rows.where("parse_error IS NULL").withColumn("part", F.expr(f"offset DIV {PART_BYTES}")).groupBy("batch_id", "part").applyInPandas(pack, PACKED)


def unpack_batches(batches: DataFrame) -> DataFrame:
    """The records of packed batches, cut out by offset and size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for b in part.itertuples(index=False):
                plain = zstandard.ZstdDecompressor().decompress(b.records, max_output_size=max(1, b.records_size))
                rows += [(b.batch_id, i["request_id"], plain[i["offset"] - b.start : i["offset"] - b.start + i["size"]].decode()) for i in json.loads(b.envelope)["records"]]
            yield pd.DataFrame(rows, columns=["batch_id", "request_id", "data"])

    return batches.mapInPandas(run, "batch_id string, request_id string, data string")
