"""The record store as versions of a manifest: what no version names is gone for good.

Bodies lie in Parquet files of their day.  A version names the folders of every
day, what of them is delivered (ranges of ids), what is withdrawn row by row,
the quarantine, and the batches that are on their way.  Each change writes its
files under new names first and then the next version, in one step that fails
where another writer was first; it is then made again on top of that one's.  So
a change that is cut short leaves the old version, and files that no version
names, which ``vacuum`` removes.

Of each day and id there is one row: a write takes older rows of its keys out
of their folders.  So readers need no window over the store.  Files are sorted
by id, whose statistics they carry.  A batch is a few ranges of ids of what an
earlier version held, so reading it is a filter that skips days, files and row
groups, and moves no body through a shuffle.

Withdrawal rewrites the folders that hold the project and deletes the old ones
with the versions that named them.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, store
from ..operators.envelope import lenient_project_hash
from .numbered import Files, Log, Taken

RECORDS = "day string, request_id string, session_key string, timestamp timestamp, project_id_hash string, data string, size long, gen string"
REJECTED = "batch_id string, day string, request_id string, session_key string, timestamp timestamp, project_id_hash string, data string, details string"
#: Folders of a day, or ranges of it, from which on it is compacted.
MOST_PIECES = 16
#: Last writes that a repetition can replace.
REMEMBERED = 64
#: Rows of keys that a join may copy to every task.  Files pack ids so well that their size, by which Spark decides, says little of what they take on the driver.
FEW_ROWS = 10_000


class Stale(Exception):
    """What a change was built on is no longer there."""


def _empty() -> dict:
    # gens: when the rows of a write came; gone: what is delivered of a day; withdrawn: tables of single rows that are gone
    return {"days": {}, "gens": {}, "gone": {}, "withdrawn": [], "rejected": [], "pins": {}, "writes": {}}


def _top(folder: str) -> str:
    """The folder that one write made, of which this one is a part."""
    return "/".join(folder.split("/")[:2])


def _within(ranges: list, gens: dict[str, int]) -> Column:
    """Whether a row lies in one of the ranges (day, after, last, version) and came with that version or before."""
    found = F.lit(False)
    for day, after, last, version in ranges:
        later = [g for g, v in gens.items() if v > version]
        old = ~F.col("gen").isin(later) if later else F.lit(True)
        found = found | ((F.col("day") == day) & (F.col("request_id") > after) & (F.col("request_id") <= last) & old)
    return found


def _keys(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, ``n`` of them, as one side of a join."""
    return rows if n <= FEW_ROWS else rows.hint("merge")


class TableSpool:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = Log(spark, f"{path}/versions")
        self.files = Files(spark, path)
        self._held: list[str] = []

    # ---- versions

    def manifest(self) -> dict:
        return self.log.latest()[1] or _empty()

    def snapshot(self) -> tuple[DataFrame, int]:
        """What is stored, and the version that says so."""
        number, m = self.log.latest()
        return self.rows(m or _empty()), number

    def commit(self, change: Callable[[dict, int], dict]) -> None:
        """The latest version changed by ``change`` (of the version and the new one's number), however many others write."""
        while True:
            n, now = self.log.latest()
            new = change(now or _empty(), n + 1)
            live = {g for folders in new["days"].values() for f in folders for g in f["gens"]}
            new["gens"] = {g: v for g, v in new["gens"].items() if g in live}
            try:
                return self.log.append(n + 1, new)
            except Taken:
                continue

    def _name(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    def _parquet(self, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in folders))

    # ---- rows

    def rows(self, manifest: dict | None = None, days: list[str] | None = None) -> DataFrame:
        """What is stored, without what is delivered or withdrawn."""
        m = manifest or self.manifest()
        chosen = sorted(m["days"] if days is None else set(days) & set(m["days"]))
        found = self._parquet(RECORDS, [f["at"] for d in chosen for f in m["days"][d]])
        ranges = [[d, *r] for d in chosen for r in m["gone"].get(d, [])]
        if ranges:
            found = found.where(~_within(ranges, m["gens"]))
        tables = [t["at"] for t in m["withdrawn"] if set(t["days"]) & set(chosen)]
        if tables:
            n = sum(t.get("rows", FEW_ROWS + 1) for t in m["withdrawn"] if t["at"] in tables)  # older versions don't tell
            gone = _keys(self._parquet("day string, request_id string, gen string", tables), n)
            found = found.join(gone, ["day", "request_id", "gen"], "left_anti")
        return found

    def _write(self, rows: DataFrame, folder: str, clustered: bool = False) -> dict[str, dict]:
        """Rows in folders of their days, sorted by id: what a version says about each."""
        columns = [c.split()[0] for c in RECORDS.split(", ")]
        out = rows.select(*columns, F.col("day").alias("of_day"))
        # days in few tasks each, as many as their bytes need: else every task would have a file for every day
        out = out.repartitionByRange("of_day", "request_id") if clustered else out.hint("rebalance", "of_day")
        out = out.sortWithinPartitions("of_day", "request_id")
        out.write.option("compression", "zstd").partitionBy("of_day").parquet(f"{self.path}/{folder}")
        facts = self._parquet(RECORDS, [folder]).groupBy("day").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.collect_set("gen").alias("gens"))
        return {r["day"]: {"at": f"{folder}/of_day={r['day']}", "rows": r["n"], "bytes": r["bytes"] or 0, "gens": sorted(r["gens"])} for r in facts.collect()}  # a row per day

    def write(self, records: DataFrame, written: int | str | None = None) -> None:
        """Add storable records; of a day and id the last write stays, and in one write the greatest timestamp.

        A write that has the number of an earlier one replaces all of what
        that one wrote, as a repeated micro-batch has to.
        """
        fresh = store.last_write(store.storable(records), "ts").withColumn("timestamp", F.col("ts")).drop("ts")
        gen, folder = uuid.uuid4().hex, self._name("records")
        for name, kind in (("session_key", "string"), ("project_id_hash", "string")):
            fresh = fresh if name in fresh.columns else fresh.withColumn(name, F.lit(None).cast(kind))
        made = self._write(fresh.withColumn("gen", F.lit(gen)), folder)
        keys = _keys(self._parquet(RECORDS, [folder]).select("day", "request_id"), sum(f["rows"] for f in made.values()))
        self._replace(lambda m: {d for d in made if d in m["days"]}, lambda rows: rows.join(keys, ["day", "request_id"], "left_semi"), self._added(made, gen, written), written)

    def _added(self, made: dict[str, dict], gen: str, written: int | str | None = None) -> Callable[[dict, int], None]:
        def add(m: dict, number: int) -> None:
            for day, facts in made.items():
                m["days"].setdefault(day, []).append(facts)
            m["gens"][gen] = number
            if written is not None:
                m["writes"] = dict([*m["writes"].items(), (str(written), gen)][-REMEMBERED:])

        return add

    def _replace(self, days: Callable[[dict], set[str]], lost: Callable[[DataFrame], DataFrame], then: Callable[[dict, int], None] = lambda m, n: None, written: int | str | None = None) -> list[str]:
        """Commit a version in which the folders that hold ``lost`` rows are rewritten without them; the old folders' names.

        Only ids are read to find those folders, and only bodies of those
        folders are read and written.
        """
        while True:
            m = self.manifest()
            again = m["writes"].get(str(written)) if written is not None else None
            old = [f for d in sorted(days(m)) for f in m["days"].get(d, []) if f["gens"] != [again]]
            drop = [f["at"] for folders in m["days"].values() for f in folders if f["gens"] == [again]]
            if old:
                at = F.regexp_extract(F.col("_metadata.file_path"), r"((?:records)/[0-9a-f]+/of_day=[^/]+)/", 1)
                hit = {r["at"]: r["count"] for r in lost(self._parquet(RECORDS, [f["at"] for f in old]).withColumn("at", at)).groupBy("at").count().collect()}  # folders
                old = [f for f in old if f["at"] in hit]
            made: dict[str, dict] = {}
            if old:
                rows = self._parquet(RECORDS, [f["at"] for f in old])
                gone = _keys(lost(rows).select("day", "request_id"), sum(hit.values()))
                made = self._write(rows.join(gone, ["day", "request_id"], "left_anti"), self._name("records"))
            names = {f["at"] for f in old} | set(drop)

            def change(now: dict, number: int, names=names, made=made, m=m) -> dict:
                there = {f["at"] for folders in now["days"].values() for f in folders}
                if not names <= there or (set(now["days"]) & days(now)) - set(m["days"]) or any(now["days"].get(d) != m["days"].get(d) for d in days(m)):
                    raise Stale
                now["days"] = {d: kept for d, folders in now["days"].items() if (kept := [f for f in folders if f["at"] not in names])}
                for day, facts in made.items():
                    now["days"].setdefault(day, []).append(facts)
                then(now, number)
                return now

            try:
                self.commit(change)
                return sorted(names)
            except Stale:
                continue

    # ---- batches on their way

    def pin(self, ranges: DataFrame | list, version: int) -> None:
        """Note which rows batches have: ranges (batch_id, day, after, last) of what ``version`` held."""
        found: dict[str, list] = {}
        rows = ranges if isinstance(ranges, list) else ranges.collect()  # a row per batch in flight and day
        for r in sorted(rows, key=lambda r: (r["batch_id"], r["day"])):
            found.setdefault(r["batch_id"], []).append([r["day"], r["after"], r["last"], version])

        def change(m: dict, number: int) -> dict:
            m["pins"] = {b: found[b] for b in sorted(found)}
            return m

        self.commit(change)

    def batches(self, ids: tuple[str, ...]) -> DataFrame:
        """The rows, with batch_id, that pinned batches still have."""
        m = self.manifest()
        pins = {b: m["pins"][b] for b in ids if b in m["pins"]}
        rows = self.rows(m, sorted({r[0] for ranges in pins.values() for r in ranges}))
        name = F.lit(None).cast("string")
        for b, ranges in pins.items():
            name = F.when(_within(ranges, m["gens"]), F.lit(b)).otherwise(name)
        every = [r for ranges in pins.values() for r in ranges]
        return rows.where(_within(every, m["gens"])).withColumn("batch_id", name)

    def mark(self) -> tuple:
        """What is withdrawn, and in which folders the rest lies; deliveries do not change it."""
        m = self.manifest()
        return frozenset(t["at"] for t in m["withdrawn"]), frozenset(f["at"] for folders in m["days"].values() for f in folders)

    def holds(self, mark: tuple) -> bool:
        """Whether all that was stored at a mark still is, but for what was delivered since."""
        withdrawn, folders = self.mark()
        return withdrawn == mark[0] and mark[1] <= folders

    def settle(self, batch_id: str) -> None:
        """Let go of a batch and of its rows."""

        def change(m: dict, number: int) -> dict:
            for day, after, last, version in m["pins"].pop(batch_id, []):
                gone = m["gone"].setdefault(day, [])
                if gone and gone[-1][1:] == [after, version]:
                    gone[-1][1] = last
                else:
                    gone.append([after, last, version])
            return m

        self.commit(change)

    def remove(self, rows: DataFrame) -> None:
        """Let go of single rows (day, request_id, gen); a row that was written again since then stays."""
        folder = self._name("withdrawn")
        rows.select("day", "request_id", "gen").write.parquet(f"{self.path}/{folder}")
        days = {r["day"]: r["count"] for r in self._parquet("day string, request_id string, gen string", [folder]).groupBy("day").count().collect()}

        def change(m: dict, number: int) -> dict:
            m["withdrawn"] = [*m["withdrawn"], {"at": folder, "days": sorted(days), "rows": sum(days.values())}] if days else m["withdrawn"]
            return m

        self.commit(change)

    # ---- quarantine

    def set_aside(self, rows: DataFrame) -> None:
        """Copy rows (batch_id, data, details and what else is known) to the quarantine; a repetition replaces what it copied before."""
        folder = self._name("rejected")
        for c in REJECTED.split(", "):
            name, kind = c.split()
            rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
        columns = [c.split()[0] for c in REJECTED.split(", ")]
        rows.select(*columns, F.md5("batch_id").alias("of_batch")).write.option("compression", "zstd").partitionBy("of_batch").parquet(f"{self.path}/{folder}")
        found = self._parquet(REJECTED, [folder]).select("batch_id", F.md5(F.coalesce("details", F.lit(""))).alias("why")).distinct().collect()  # batches and reasons
        why = {b: sorted({r["why"] for r in found if r["batch_id"] == b}) for b in {r["batch_id"] for r in found}}
        places = self._places(folder)

        def change(m: dict, number: int) -> dict:
            kept = [r for r in m["rejected"] if not (r["batch_id"] in why and r["why"] == why[r["batch_id"]])]
            m["rejected"] = kept + [{"batch_id": b, "at": places[b], "why": why[b]} for b in sorted(why)]
            return m

        self.commit(change)

    def _places(self, folder: str) -> dict[str, str]:
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/(of_batch=[^/]+)/[^/]*$", 1)
        return {r["batch_id"]: f"{folder}/{r['at']}" for r in self._parquet(REJECTED, [folder]).select("batch_id", at.alias("at")).distinct().collect()}

    def rejected(self, batch_id: str | None = None) -> DataFrame:
        m = self.manifest()
        return self._parquet(REJECTED, [r["at"] for r in m["rejected"] if batch_id in (None, r["batch_id"])])

    def requeue(self, batch_id: str) -> int:
        """A batch's readable rows go back to the store, in one version; the others stay in the quarantine.  The number of rows that went back."""
        old = [r["at"] for r in self.manifest()["rejected"] if r["batch_id"] == batch_id]
        good, bad = delivery.split_readable(self._parquet(REJECTED, old))
        gen, back, left = uuid.uuid4().hex, self._name("records"), self._name("rejected")
        good = store.last_write(good, "timestamp").withColumns({"size": F.octet_length("data").cast("long"), "gen": F.lit(gen)})
        made = self._write(good, back)
        bad.select(*(c.split()[0] for c in REJECTED.split(", ")), F.md5("batch_id").alias("of_batch")).write.partitionBy("of_batch").parquet(f"{self.path}/{left}")
        places = self._places(left)
        keys = _keys(self._parquet(RECORDS, [back]).select("day", "request_id"), sum(f["rows"] for f in made.values()))
        add = self._added(made, gen)

        def then(m: dict, number: int) -> None:
            if not set(old) <= {r["at"] for r in m["rejected"]}:
                raise KeyError(f"another requeued or discarded {batch_id}")
            add(m, number)
            m["rejected"] = [r for r in m["rejected"] if r["at"] not in old] + [{"batch_id": b, "at": at, "why": ["left"]} for b, at in places.items()]

        self._replace(lambda m: set(made) & set(m["days"]), lambda rows: rows.join(keys, ["day", "request_id"], "left_semi"), then)
        self.sweep()
        return sum(f["rows"] for f in made.values())

    def discard(self, batch_id: str) -> int:
        """A batch of the quarantine goes for good; the number of its rows."""
        n = self.rejected(batch_id).count()

        def change(m: dict, number: int) -> dict:
            m["rejected"] = [r for r in m["rejected"] if r["batch_id"] != batch_id]
            return m

        self.commit(change)
        self.sweep()
        return n

    # ---- withdrawal and upkeep

    def purge(self, project: str) -> None:
        """No file keeps a row of the project, in the store or the quarantine, when this returns; rows of unknown projects stay.

        A flush that is under way loses what it holds, fails, and can be
        repeated.  After a crash the purge has to be repeated.
        """

        def lost(rows: DataFrame) -> DataFrame:
            owner = F.when(F.coalesce("project_id_hash", F.lit("")) != "", F.col("project_id_hash"))
            return rows.where(owner == project).unionByName(rows.where(owner.isNull()).where(lenient_project_hash(F.col("data")) == project))

        self._replace(lambda m: set(m["days"]), lost)
        kept = store.purge_quarantine(self.rejected().where(F.coalesce("project_id_hash", F.lit("")) != project), project)
        old, folder = self.manifest()["rejected"], self._name("rejected")
        if old:
            kept.withColumn("of_batch", F.md5("batch_id")).write.option("compression", "zstd").partitionBy("of_batch").parquet(f"{self.path}/{folder}")
            places, names = self._places(folder), {r["at"] for r in old}

            def change(m: dict, number: int) -> dict:
                whys = {b: sorted({w for r in old if r["batch_id"] == b for w in r["why"]}) for b in places}
                m["rejected"] = [r for r in m["rejected"] if r["at"] not in names] + [{"batch_id": b, "at": places[b], "why": whys[b]} for b in sorted(places)]
                return m

            self.commit(change)
        self.sweep()
        self.files.delete("work")

    def compact(self, most: int = 0) -> None:
        """Rewrite, clustered by id, the days that have more than ``most`` folders, ranges or withdrawals; what is gone leaves their files.

        Rows keep the write that they came with, by which streams know what
        they have read.  Nothing is compacted while batches are on their way.
        """
        m = self.manifest()
        torn = {d for d in m["days"] if len(m["gone"].get(d, [])) > most or len(m["days"][d]) > max(1, most) or sum(d in t["days"] for t in m["withdrawn"]) > most}
        if m["pins"] or not torn:
            return
        made = self._write(self.rows(m, sorted(torn)), self._name("records"), clustered=True)

        def change(now: dict, number: int) -> dict:
            if now["pins"] or any(now["days"].get(d) != m["days"][d] or now["gone"].get(d) != m["gone"].get(d) for d in torn) or now["withdrawn"] != m["withdrawn"]:
                raise Stale
            for d in torn:
                now["days"].pop(d)
                now["gone"].pop(d, None)
            for d, facts in made.items():
                now["days"][d] = [facts]
            for t in now["withdrawn"]:
                t["days"] = [d for d in t["days"] if d not in torn]
            now["withdrawn"] = [t for t in now["withdrawn"] if t["days"]]
            return now

        with contextlib.suppress(Stale):  # others write: the next time will do
            self.commit(change)

    def _named(self, m: dict) -> set[str]:
        return {f["at"] for folders in m["days"].values() for f in folders} | {t["at"] for t in m["withdrawn"]} | {r["at"] for r in m["rejected"]}

    def sweep(self) -> list[str]:
        """Delete the folders that only older versions name, and those versions."""
        number, m = self.log.latest()
        if m is None:
            return []
        old = set().union(*(self._named(self.log.get(n)) for n in self.log.numbers() if n < number)) - self._named(m)
        tops = {_top(at) for at in self._named(m)}
        for at in sorted({at if _top(at) in tops else _top(at) for at in old}):
            self.files.delete(at)
        self.log.forget(number)
        return sorted(old)

    def vacuum(self, grace_seconds: float = 86_400) -> list[str]:
        """Delete what no version names, such as leftovers of crashes; what was begun within ``grace_seconds`` may still be committed and stays."""
        deleted, now = self.sweep(), int(time.time() * 1000)
        tops = {_top(at) for at in self._named(self.manifest())}
        for kind in ("records", "withdrawn", "rejected", "work"):
            for at in (f"{kind}/{name}" for name in self.files.names(kind)):
                if at not in tops and self.files.age_ms(at, now) >= grace_seconds * 1000:
                    self.files.delete(at)
                    deleted.append(at)
        return deleted

    def tidy(self) -> None:
        """What is due after a flush: days in many pieces are rewritten, and what is gone is deleted."""
        self.compact(MOST_PIECES)
        self.sweep()

    # ---- work in between

    @contextlib.contextmanager
    def work(self) -> Iterator[None]:
        """What is held inside is deleted at the end."""
        before, self._held = self._held, []
        try:
            yield
        finally:
            for at in self._held:
                self.files.delete(at)
            self._held = before

    def hold(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back, until the ``work`` around it ends."""
        at = self._name("work")
        self._held.append(at)
        df.write.parquet(f"{self.path}/{at}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{at}")


def usage(manifest: dict) -> int:
    """Bytes of all bodies that the folders hold, without a scan."""
    return sum(f["bytes"] for folders in manifest["days"].values() for f in folders)
