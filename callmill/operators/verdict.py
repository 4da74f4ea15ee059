"""Routing: which exchanges may be recorded, by token and consent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy

def with_verdict(exchanges: DataFrame, routes: DataFrame, paused_reason: str = "") -> DataFrame:
    """Left join on token: unknown tokens keep their rows.  Adds project_id_hash, route_upstream and verdict.

    Whether the routes are broadcast is left to Spark, which knows their size
    from the files or, at the latest, when they have been read.
    """
    known = routes.select(F.col("token").alias("_token"), "project_id_hash", F.col("upstream").alias("route_upstream"), (F.coalesce(F.col("revoked_at"), F.lit("")) != "").alias("_revoked"))
    kept = exchanges.drop("project_id_hash", "route_upstream")
    joined = kept.join(known, kept["token"] == known["_token"], "left")
    verdict = policy.verdict(F.col("_token").isNotNull(), F.coalesce("_revoked", F.lit(False)), F.lit(paused_reason))
    return joined.withColumn("verdict", verdict).drop("_token", "_revoked")


def recordable(exchanges: DataFrame, routes: DataFrame, paused_reason: str = "", max_bytes: int = policy.MAX_RECORD_BYTES) -> DataFrame:
    """Cheap filters first, then the verdict; it is taken when rows are written, not when they arrive."""
    eligible = exchanges.where(policy.is_eligible(F.col("method"), F.col("path")) & policy.is_success(F.col("http_status")))
    eligible = eligible.where(policy.fits_record(F.col("request"), F.col("response"), max_bytes))
    return with_verdict(eligible, routes, paused_reason).where("verdict = 'record'").drop("verdict")


def abandonment(exchanges: DataFrame) -> DataFrame:
    """Counts of abandoned captures by the fixed categories; silent drops (status, withdrawn consent) are in none of them."""
    return exchanges.where(F.col("category").isin(policy.ABANDONED)).groupBy("category").agg(F.count("*").alias("n"))


# ---- the dimension's own upkeep

def grant(routes: DataFrame, row: DataFrame) -> DataFrame:
    """Adds grants; an active one of the same root is replaced."""
    return routes.join(row.select("root_path"), "root_path", "left_anti").select(routes.columns).unionByName(row.select(routes.columns))


def revoke(routes: DataFrame, root: str, at: str) -> DataFrame:
    """The grant stays, marked."""
    hit = (F.col("root_path") == root) & (F.coalesce(F.col("revoked_at"), F.lit("")) == "")
    return routes.withColumn("revoked_at", F.when(hit, F.lit(at)).otherwise(F.col("revoked_at")))


def snapshot(routes: DataFrame, root: str) -> DataFrame:
    """The root's entries, revoked ones included."""
    return routes.where(F.col("root_path") == root)


def restore(routes: DataFrame, root: str, entries: DataFrame) -> DataFrame:
    """The root back to what a snapshot holds, nothing included; other roots stay as they are now."""
    return routes.where(~F.col("root_path").eqNullSafe(F.lit(root))).unionByName(entries.select(routes.columns))


def set_upstream(routes: DataFrame, root: str, upstream: str) -> DataFrame:
    hit = (F.col("root_path") == root) & (F.coalesce(F.col("revoked_at"), F.lit("")) == "")
    return routes.withColumn("upstream", F.when(hit, F.lit(upstream)).otherwise(F.col("upstream")))


def pause(current: str, reason: str) -> str:
    return current or reason


def resume(current: str, reason: str) -> str:
    """A pause is lifted by its own reason only."""
    return "" if current == reason else current


def agreement_pause(accepted: str, current: str, paused_reason: str) -> str:
    """A stale agreement pauses the device; confirming it lifts that pause alone."""
    if accepted and accepted != current:
        return pause(paused_reason, "consent_reconfirm")
    return resume(paused_reason, "consent_reconfirm")


def agreement_pause_of(accepted: Column, current: Column, paused_reason: Column) -> Column:
    """``agreement_pause`` of columns."""
    stale = (accepted != "") & (accepted != current)
    return F.when(stale & (paused_reason == ""), "consent_reconfirm").when(~stale & (paused_reason == "consent_reconfirm"), "").otherwise(paused_reason)


def grants(tables: DataFrame) -> DataFrame:
    """Rows of a routing table kept as a map from token to grant."""
    rows = tables.select(F.explode("grants").alias("token", "grant")).select("token", "grant.*")
    return rows.withColumn("revoked", F.coalesce(F.col("revoked_at"), F.lit("")) != "")


def active_grants(routes: DataFrame) -> DataFrame:
    return routes.where(F.coalesce(F.col("revoked_at"), F.lit("")) == "")


def identity_disagreements(routes: DataFrame) -> DataFrame:
    """Grants whose hash isn't that of their root."""
    return routes.where(F.col("project_id_hash") != policy.project_hash(F.col("root_path")))


def project_status(routes: DataFrame, consent: DataFrame, injected: DataFrame) -> DataFrame:
    """Grants, consent and injected settings side by side, by root."""
    g = active_grants(routes).select("root_path", "token", "project_id_hash")
    c = consent.select("root_path", F.col("state").alias("consent"))
    i = injected.select("root_path", F.col("token").alias("injected_token"))
    out = g.join(c, "root_path", "full_outer").join(i, "root_path", "full_outer")
    return out.withColumn("in_step", F.coalesce((F.col("consent") == "granted") & F.col("token").eqNullSafe(F.col("injected_token")) & F.col("token").isNotNull(), F.lit(False)))


def mark_prompted(prompted: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The set with the hashes added, and those that are new in it."""
    new = hashes.select("project_id_hash").distinct().join(prompted, "project_id_hash", "left_anti")
    return prompted.unionByName(new), new


def selfcheck(tokens: DataFrame, routes: DataFrame, paused_reason: str, official: str, usage: int, quota: int) -> DataFrame:
    """One row per token: known, recording, decision, pause reason, project, origin, writable."""
    v = with_verdict(tokens.select("token"), routes, paused_reason)
    return v.select(
        "token", (F.col("verdict") != "unknown").alias("known"), (F.col("verdict") == "record").alias("recording"), F.col("verdict").alias("decision"),
        F.lit(paused_reason).alias("pause_reason"), "project_id_hash", policy.upstream_origin(F.col("route_upstream"), F.lit(official)).alias("origin"),
        policy.is_writable(F.lit(usage), F.lit(quota), F.lit(True)).alias("writable"),
    )
