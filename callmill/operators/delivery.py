"""Acknowledged delivery as explicit state.

A flush is one transition: it takes a store and the state, delivers bounded
batches through a sink, and leaves both so that it can be cut short anywhere
and repeated:

1. All rows are cut into batches in one job.
2. The batches' ids and the ranges of rows that they have are pinned, a few
   batches at a time, and the state that names them is saved, before anything
   is sent.
3. Rows whose records can't be read are copied to the quarantine, then removed
   from the store.
4. The others are masked, packed and sent.  After an acknowledgement that names
   the batch the store lets go of its ranges, and only then the state of its id;
   after a rejection they are copied to the quarantine first.

A repeated flush resends what is pinned under the same id, from the rows that
are still there, so a sink that is idempotent by batch id gets each row once.
Ids stay in tables; the driver holds the few batches in flight.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import AbstractContextManager
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from . import batching, envelope, folds


@dataclass(frozen=True)
class Response:
    """What a sink answers: an HTTP status, the batch it acknowledges, and the service's settings."""

    status: int
    batch_id: str = ""
    details: str = ""
    retry_after: int = 0
    min_client_version: str = ""
    handshake: dict = field(default_factory=dict)


class Sink(Protocol):
    def deliver(self, batch: DataFrame) -> Response:
        """``batch`` is made by ``pack_batches``: a row per part, which is one but for large batches.  Delivery has to be idempotent by batch id."""


@dataclass
class FileSink:
    """Writes each batch as a Parquet file of its own; repeating a delivery overwrites it."""

    folder: str

    def deliver(self, batch: DataFrame) -> Response:
        batch_id = batch.select("batch_id").first()["batch_id"]
        batch.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}")
        return Response(200, batch_id)


class Spool(Protocol):
    """A store with a quarantine.  Every method has taken effect for good when it returns, and may be repeated."""

    def snapshot(self) -> tuple[DataFrame, int]:
        """day, request_id, session_key, timestamp, size, data and project_id_hash of what is stored, and the version that holds it."""

    def pin(self, ranges: DataFrame | list, version: int) -> None:
        """Note which rows batches have: of a version, by batch_id and day, the ids behind ``after`` up to ``last``."""

    def batches(self, ids: tuple[str, ...]) -> DataFrame:
        """The rows that pinned batches still have, with batch_id."""

    def mark(self) -> object:
        """What is stored, but for deliveries."""

    def holds(self, mark: object) -> bool:
        """Whether all that was stored at a mark still is, but for what was delivered since."""

    def settle(self, batch_id: str) -> None:
        """Let go of a batch and of its rows."""

    def remove(self, rows: DataFrame) -> None:
        """Let go of single rows."""

    def set_aside(self, rows: DataFrame) -> None:
        """Copy rows with batch_id and details to the quarantine."""

    def work(self) -> AbstractContextManager[None]:
        """What is held inside is deleted at the end."""

    def hold(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back."""

    def tidy(self) -> None:
        """Upkeep after a flush."""


@dataclass(frozen=True)
class State:
    """What outlives a flush.  Gates hold back unforced flushes only, and any acknowledgement lifts them."""

    pending: tuple[str, ...] = ()
    not_before: float = 0.0
    timeouts: int = 0
    upgrade_required: bool = False
    min_client_version: str = ""
    handshake: dict = field(default_factory=dict)
    last_error: str = ""
    last_attempt: float = 0.0
    last_upload: float = 0.0
    last_rejected: str = ""
    receipt: dict = field(default_factory=dict)
    closed: bool = False

    @property
    def quota(self) -> int:
        """Bytes that the store may hold: what the service set, else the default."""
        return self.handshake.get("quota_bytes") or policy.QUOTA_BYTES


@dataclass
class Flush:
    """The reply of a flush."""

    outcome: str
    state: State
    batches: int = 0
    records: int = 0
    unreadable: int = 0
    error: str = ""


def merge_handshake(old: dict, new: dict) -> dict:
    """Settings that are set overlay those stored."""
    return old | {k: v for k, v in new.items() if v}


def backoff(timeouts: int) -> int:
    return min(60 * 2 ** min(max(timeouts - 1, 0), 20), policy.MAX_BACKOFF)


def settle(state: State, answer: Response, now: float, batch_id: str, n: int) -> State:
    """The state after an answer that is no acknowledgement."""
    error = f"status {answer.status}"
    if answer.status == 408:
        return replace(state, timeouts=state.timeouts + 1, not_before=now + backoff(state.timeouts + 1), last_error=error)
    if answer.status == 426:
        return replace(state, upgrade_required=True, min_client_version=answer.min_client_version, last_error=error)
    if answer.status == 429:
        pause = min(answer.retry_after, policy.MAX_RETRY_AFTER) if answer.retry_after > 0 else policy.RATE_LIMIT_PAUSE
        return replace(state, not_before=now + pause, last_error=error)
    if answer.status != 401 and 400 <= answer.status < 500:
        return replace(state, last_rejected=f"{batch_id}: {n} records", last_error=error)
    return replace(state, last_error=error)


def split_readable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose records can be read, and the others with the reason."""
    marked = envelope.parsed(rows).drop("record")
    return marked.where("parse_error IS NULL").drop("parse_error"), marked.where("parse_error IS NOT NULL")


def flush(
    spool: Spool, state: State, sink: Sink, now: float, force: bool = False, signed_in: bool = True, client_version: str = "0.0.0", new_id: Callable[[], str] = lambda: f"b-{uuid.uuid4().hex}",
    save: Callable[[State], None] = lambda s: None, at_once: int = 1, budget: float | None = None, clock: Callable[[], float] = time.monotonic,
) -> Flush:
    """Deliver what the store holds.

    ``at_once`` batches are pinned and packed together; with more than one,
    the later ones of those have been packed in vain where an earlier one
    fails.  After ``budget`` seconds no further batch is begun.
    """
    end = None if budget is None else clock() + budget
    if state.closed:
        return Flush("paused", state, error="closed")
    if not signed_in:
        return Flush("paused", state)
    if not force and state.upgrade_required:
        return Flush("upgrade_required", state)
    if not force and now < state.not_before:
        return Flush("deferred", state)
    out = Flush("empty", state)
    spent = lambda: end is not None and clock() >= end
    if state.pending and not _deliver(out, spool, sink, now, client_version, save, spent):
        return out
    limit = out.state.handshake.get("flush_bytes") or policy.FLUSH_BYTES
    max_age = out.state.handshake.get("flush_age_seconds") or policy.FLUSH_AGE_SECONDS
    marks = [spool.mark()]
    stored, version = spool.snapshot()
    rows = stored.select("day", "request_id", "size", "timestamp")
    if not out.batches and not force:
        facts = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("usage"), F.min(F.struct("day", F.coalesce(F.col("timestamp").cast("double"), F.lit(float("inf"))).alias("at"))).alias("first")).first()
        if not facts["usage"]:
            return out
        oldest = facts["first"]["at"]
        if facts["usage"] < limit and now - min(oldest, now) < max_age:
            out.outcome = "below_threshold"
            return out
    with spool.work():
        cut = spool.hold(cut_batches(rows, limit))
        ranges = spool.hold(batch_ranges(cut))
        n = ranges.agg(F.coalesce(F.max("bin") + 1, F.lit(0))).first()[0]
        ahead = max(1, AHEAD_BYTES // max(1, limit) // at_once) * at_once if budget is None else at_once
        at, width = 0, at_once  # a service that doesn't answer costs the first few batches only
        while at < n:
            if spent():
                out.error = "budget spent"
                return out
            if not _deliver_window(out, spool, sink, now, client_version, save, spent, stored, version, marks, cut, ranges, range(at, min(n, at + width)), at_once, new_id):
                return out
            at, width = at + width, ahead
    spool.tidy()
    if out.batches:
        out.outcome = "uploaded"
    return out


def batch_ranges(cut: DataFrame) -> DataFrame:
    """bin, day, and the ids (behind ``after``, up to ``last``) that a bin has of the day: a row per bin and day."""
    spans = cut.groupBy("day", "bin").agg(F.max("request_id").alias("last"))
    before = F.lag("last", 1, "").over(Window.partitionBy("day").orderBy("bin"))
    return spans.select("bin", "day", before.alias("after"), "last")


def cut_batches(rows: DataFrame, limit: int) -> DataFrame:
    """day, request_id and bin: rows in scan order (day, then id) fill a bin up to and including the one that reaches the limit.

    Only days, ids and sizes are read, once for a whole flush.
    """
    return folds.greedy_bins(rows.select(F.struct("day", "request_id").alias("seq"), "size"), limit, key=None).select("seq.day", "seq.request_id", "bin")


#: Bytes of batches that are packed in one go, before the first of them is sent.
AHEAD_BYTES = 64 << 20


def _deliver_window(
    out: Flush, spool: Spool, sink: Sink, now: float, client_version: str, save: Callable[[State], None], spent: Callable[[], bool], stored: DataFrame, version: int, marks: list,
    cut: DataFrame, ranges: DataFrame, bins: range, at_once: int, new_id: Callable[[], str],
) -> bool:
    """Pack some bins in one go, then pin and deliver ``at_once`` at a time; True if all were acknowledged or had nothing to send."""
    with spool.work():
        chosen = F.col("bin").between(bins.start, bins.stop - 1)
        spans: dict[int, list] = {}
        for r in ranges.where(chosen).collect():  # a row per batch packed together and day
            spans.setdefault(r["bin"], []).append(r)
        ids = {b: new_id() for b in bins}
        packed = None
        if len(bins) > at_once and spool.holds(marks[-1]):
            name = F.element_at(F.array(*(F.lit(ids[b]) for b in bins)), (F.col("bin") - bins.start + 1).cast("int"))
            mine = cut.where(chosen).select("day", "request_id", name.alias("batch_id"))
            # merged, never broadcast: files pack ids so well that their size says little of what they take on the driver
            packed = _pack(spool, stored.where(_across([r for found in spans.values() for r in found])).join(mine.hint("merge"), ["day", "request_id"]), now, client_version)
        for at in range(bins.start, bins.stop, at_once):
            if spent():
                out.error = "budget spent"
                return False
            group = range(at, min(bins.stop, at + at_once))
            spool.pin([{"batch_id": ids[b], "day": r["day"], "after": r["after"], "last": r["last"]} for b in group for r in spans[b]], version)
            out.state = replace(out.state, pending=tuple(ids[b] for b in group))
            save(out.state)  # before the first attempt
            same, before = spool.holds(marks[-1]), out.unreadable
            if not same:  # others withdrew rows or wrote folders anew: what was packed, or would be by the snapshot, no longer counts
                packed = None
            if not _deliver(out, spool, sink, now, client_version, save, spent, packed):
                return False
            if same and out.unreadable > before:  # rows that can't be read have left the store
                marks.append(spool.mark())
    return True


def _across(spans: list) -> Column:
    """Whether a row lies between the first and the last of some neighbouring bins' rows, in scan order."""
    day, after = min((r["day"], r["after"]) for r in spans)
    end, last = max((r["day"], r["last"]) for r in spans)
    begun = (F.col("day") > day) | ((F.col("day") == day) & (F.col("request_id") > after))
    return begun & ((F.col("day") < end) | ((F.col("day") == end) & (F.col("request_id") <= last)))


@dataclass
class _Packed:
    """Batches that are ready to be sent, and the rows that can't be read."""

    batches: DataFrame
    sizes: dict[str, tuple[int, int]]  # records and bytes
    files: dict[str, list[str]]
    unreadable: DataFrame
    bad: dict[str, int]

    def batch(self, batch_id: str) -> DataFrame:
        """From its own files, not all that were packed together."""
        return self.batches.where(F.col("_metadata.file_path").isin(self.files[batch_id]) & (F.col("batch_id") == batch_id))


def _pack(spool: Spool, rows: DataFrame, now: float, client_version: str) -> _Packed:
    """Every text is read and masked once, in as many tasks as there are cores: the store's files are few."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    good, bad = split_readable(spool.hold(rows.repartition(cores, "request_id")))
    bad = spool.hold(bad)
    facts = spool.hold(batching.masked(good))
    packed = spool.hold(batching.pack_batches(batching.placed(facts, spool.hold), client_version, str(now)).hint("rebalance"))
    size = F.sum(F.octet_length("envelope") + F.octet_length("records"))
    found = packed.withColumn("at", F.col("_metadata.file_path")).groupBy("batch_id").agg(F.sum("n_records").alias("n"), size.alias("bytes"), F.collect_set("at").alias("files")).collect()  # a row per batch packed together
    sizes, files = {r["batch_id"]: (r["n"], r["bytes"]) for r in found}, {r["batch_id"]: r["files"] for r in found}
    return _Packed(packed, sizes, files, bad, {r["batch_id"]: r["count"] for r in bad.groupBy("batch_id").count().collect()})


def _deliver(out: Flush, spool: Spool, sink: Sink, now: float, client_version: str, save: Callable[[State], None], spent: Callable[[], bool], packed: _Packed | None = None) -> bool:
    """Deliver the pending batches in order; True if all were acknowledged or had nothing to send."""
    with spool.work():  # bodies are held while their batches are on their way, no longer
        packed = packed or _pack(spool, spool.batches(out.state.pending), now, client_version)
        return _deliver_held(out, spool, sink, now, save, spent, packed)


def _deliver_held(out: Flush, spool: Spool, sink: Sink, now: float, save: Callable[[State], None], spent: Callable[[], bool], packed: _Packed) -> bool:
    ids = out.state.pending
    if n_bad := sum(packed.bad.get(x, 0) for x in ids):
        bad = packed.unreadable.where(F.col("batch_id").isin(list(ids)))
        spool.set_aside(bad.withColumn("details", F.col("parse_error")).drop("parse_error"))
        spool.remove(bad)
        out.unreadable += n_bad
    for batch_id in ids:
        left = tuple(x for x in out.state.pending if x != batch_id)
        if batch_id not in packed.sizes:  # withdrawn, or all set aside
            spool.settle(batch_id)
            out.state = replace(out.state, pending=left)
            save(out.state)
            continue
        if spent():
            out.error = "budget spent"
            return False
        n, n_bytes = packed.sizes[batch_id]
        answer = sink.deliver(packed.batch(batch_id))
        out.state = replace(out.state, last_attempt=now)
        if 200 <= answer.status < 300 and answer.batch_id == batch_id:
            spool.settle(batch_id)
            receipt = {"batch_id": batch_id, "records": n, "bytes": n_bytes, "at": now}
            out.batches, out.records = out.batches + 1, out.records + n
            out.state = replace(out.state, pending=left, not_before=0.0, timeouts=0, upgrade_required=False, min_client_version="", last_error="", last_upload=now, receipt=receipt, handshake=merge_handshake(out.state.handshake, answer.handshake))
            save(out.state)
            continue
        status = answer if not 200 <= answer.status < 300 else replace(answer, status=502)  # an answer for another batch is none
        kind = policy_class(status.status)
        out.state = settle(out.state, status, now, batch_id, n)
        if kind == "rejected":
            spool.set_aside(spool.batches((batch_id,)).withColumn("details", F.lit(f"{status.status}: {status.details}"[: policy.TEXT_RUNES])))
            spool.settle(batch_id)
            out.state = replace(out.state, pending=left)
        out.outcome = {"upgrade": "upgrade_required", "limited": "deferred", "timeout": "deferred", "rejected": "rejected"}.get(kind, "paused")
        out.error = out.state.last_error
        save(out.state)
        return False
    return True


def policy_class(status: int) -> str:
    return policy.FAILURES.get(status, "rejected" if 400 <= status < 500 else "transient")


def close(spool: Spool, state: State, sink: Sink, now: float, budget: float = policy.EXIT_BUDGET_SECONDS, save: Callable[[State], None] = lambda s: None, **options) -> Flush:
    """The flush at the end, unforced and within a budget; later ones are refused.  A state that is closed stays as it is."""
    if state.closed:
        return Flush("paused", state, error="closed")
    out = flush(spool, state, sink, now, budget=budget, save=save, **options)
    out.state = replace(out.state, closed=True)
    save(out.state)
    return out


# ---- quarantine

def requeue(rejected: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows that go back to the store, and the quarantine without them; unreadable rows stay."""
    chosen = rejected.where(F.col("batch_id") == batch_id)
    good, bad = split_readable(chosen)
    return good.drop("batch_id", "details"), rejected.where(F.col("batch_id") != batch_id).unionByName(bad.select(rejected.columns))


def discard(rejected: DataFrame, batch_id: str) -> tuple[DataFrame, int]:
    """The quarantine without a batch, and how many rows it had."""
    return rejected.where(F.col("batch_id") != batch_id), rejected.where(F.col("batch_id") == batch_id).count()
