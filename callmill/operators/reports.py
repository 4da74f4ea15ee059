"""Counters and listings over the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy


def counters(captures: DataFrame) -> DataFrame:
    """recorded, degraded, dropped and unusable_upstream, as one row."""
    return captures.agg(
        F.count_if(F.col("outcome") == "recorded").alias("recorded"), F.count_if((F.col("outcome") == "recorded") & F.col("garbled")).alias("degraded"),
        F.count_if(F.col("outcome") == "dropped").alias("dropped"), F.count_if(F.col("outcome") == "unusable_upstream").alias("unusable_upstream"),
    )


def recent_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    """The last n errors; a top-k, so no task sorts them all."""
    return errors.orderBy(F.col("at").desc(), F.col("seq").desc()).limit(n)


def health(captures: DataFrame, errors: DataFrame) -> DataFrame:
    """The counters with the last errors as one row."""
    last = recent_errors(errors).agg(F.sort_array(F.collect_list(F.struct("at", "seq", "message"))).alias("recent_errors"))
    return counters(captures).crossJoin(last)  # one row each


def quarantine_list(rejected: DataFrame) -> DataFrame:
    """Batches set aside, by id."""
    return rejected.groupBy("batch_id").agg(F.count("*").alias("records"), F.coalesce(F.max("details"), F.lit("")).alias("details")).orderBy("batch_id")


def quarantine_totals(rejected: DataFrame) -> DataFrame:
    return rejected.agg(F.count_distinct("batch_id").alias("batches"), F.count("*").alias("records"))


def flush_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("outcome") == "uploaded").alias("batches"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("unreadable"), F.lit(0)).alias("unreadable"))


def newest_release(releases: DataFrame) -> DataFrame:
    """The greatest version among published releases that have both assets; of equal ones the first."""
    usable = releases.where("NOT draft AND has_archive AND has_checksums").withColumn("_key", policy.version_key(F.col("version"))).where("_key IS NOT NULL")
    return usable.orderBy(F.col("_key").desc(), F.col("seq").asc()).limit(1).drop("_key")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def findings(devices: DataFrame, rejected: DataFrame) -> DataFrame:
    """What is to be said about each device: device, place (store, quarantine or service), severity and text.

    ``devices`` has a row per device: usage and quota in bytes, write_error,
    min_client_version, version, upgrade_message and notice; ``rejected`` has
    device and batch_id of the rows set aside.  Nulls count as nothing said, a
    null quota as none.  A device without a fault has one ``ok`` row a place,
    but none for a service that said nothing.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    used = F.concat(policy.human_bytes(F.coalesce("usage", F.lit(0)).cast("long")), F.coalesce(F.concat(F.lit(" of "), policy.human_bytes(F.col("quota").cast("long"))), F.lit("")), F.lit(" used"))
    full = F.coalesce(F.col("usage") >= F.col("quota"), F.lit(False))
    row = lambda place, severity, text: F.struct(F.lit(place).alias("place"), severity.alias("severity"), text.alias("text"))
    note = lambda when, text: F.when(when, row("service", policy.severity(F.lit(False), when, F.lit(False)), text))
    broken, aside = (said("write_error") != "") | full, F.col("n_batches") > 0
    found = F.array(
        row("store", policy.severity(broken, F.lit(False), F.lit(False)), F.concat(F.when(said("write_error") != "", F.concat(F.lit("takes no writes: "), F.col("write_error"), F.lit(", "))).when(full, "full, ").otherwise("takes writes, "), used)),
        row("quarantine", policy.severity(aside, F.lit(False), F.lit(False)), F.when(aside, F.concat(F.col("n_batches").cast("string"), F.lit(" batches set aside"))).otherwise("empty")),
        note(policy.version_standing(F.col("min_client_version"), F.col("version")) != "satisfied", F.concat(F.lit("wants version "), said("min_client_version"), F.lit(" or newer, this is "), said("version"))),
        note(said("upgrade_message") != "", F.concat(F.lit("says: "), said("upgrade_message"))),
        note(said("notice") != "", F.concat(F.lit("notice: "), said("notice"))),
    )
    counts = rejected.groupBy("device").agg(F.count_distinct("batch_id").alias("n_batches"))
    facts = devices.select("device", "usage", "quota", "write_error", "min_client_version", "version", "upgrade_message", "notice")
    return facts.join(counts, "device", "left").withColumn("n_batches", F.coalesce("n_batches", F.lit(0))).select("device", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("device", "f.*")


def distinct_roots(routes: DataFrame) -> DataFrame:
    return routes.select("root_path").distinct().orderBy("root_path")


def crash_gave_up(crashes: DataFrame, window_seconds: int, most: int) -> DataFrame:
    """Adds gave_up: more than ``most`` crashes of a process within the window that ends here."""
    recent = Window.partitionBy("process").orderBy("at").rangeBetween(-window_seconds, 0)
    return crashes.withColumn("gave_up", F.count("*").over(recent) > most)
