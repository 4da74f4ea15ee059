"""Folds over ordered rows that have no window form, in many tasks.

Rows are cut into chunks by ranges of (key, seq) and written once, in order; a
key's rows may span many chunks.  What a chunk does to the fold's state is
found in parallel, and only states at the borders of chunks, a few numbers a
chunk, pass through the driver.

``greedy_bins`` speculates: all chunks are folded at once from the states that
their predecessors had last; those whose start has changed are folded again,
until none has.  Folds from different starts often meet at the end of a common
bin, after which they agree.  Where they never do, as with equal sizes, after
``ROUNDS`` rounds one chunk after the other is settled, which costs what a
sequential fold does.

``admitted`` decides whole chunks at once: all of a chunk's writes while even
their largest running sum fits, none where even the least need is more than the
room that is left.  Only chunks in between are folded write by write.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import Scratch

ROUNDS = 4


def _order(key: str | None) -> list[str]:
    return [key, "seq"] if key else ["seq"]


def chunked(rows: DataFrame, key: str | None, scratch: Scratch, chunks: int | None = None) -> DataFrame:
    """Rows by ranges of (key, seq), in order within each chunk, with _part, the chunk's place; written."""
    spread = rows.repartitionByRange(*([chunks] if chunks else []), *map(F.col, _order(key))).sortWithinPartitions(*_order(key))
    return scratch.table(spread.withColumn("_part", F.spark_partition_id()), "chunks", ("_part",))


def in_order(table: DataFrame, key: str | None) -> DataFrame:
    """Each chunk as one partition, in order: a chunk's file may have been read in several splits."""
    parts = table.agg(F.max("_part")).first()[0]
    return table.repartition((parts or 0) + 1, "_part").sortWithinPartitions("_part", *_order(key))


# ---- bins

class _Bins:
    """The fold of one run of rows: open bytes and closed bins of the current key."""

    def __init__(self, limit: int):
        self.limit, self.total, self.closed = limit, 0, 0

    def run(self, sizes: np.ndarray) -> np.ndarray:
        """Bins of the next rows of the same key."""
        sums, out, at, before = np.cumsum(sizes), np.empty(len(sizes), np.int64), 0, 0
        while at < len(sizes):
            end = max(at, int(np.searchsorted(sums, before + self.limit - self.total)))
            out[at : end + 1] = self.closed
            if end >= len(sizes):
                self.total += int(sums[-1]) - before
                return out
            before, at, self.total, self.closed = int(sums[end]), end + 1, 0, self.closed + 1
        return out


def _runs(batch: pa.RecordBatch, key: str | None) -> Iterator[tuple[tuple, int, int]]:
    """(chunk and key, start, end) of equal neighbours."""
    parts = batch.column(batch.schema.get_field_index("_part")).to_pylist()
    keys = batch.column(batch.schema.get_field_index(key)).to_pylist() if key else [None] * len(parts)
    start = 0
    for i in range(1, len(parts) + 1):
        if i == len(parts) or parts[i] != parts[start] or keys[i] != keys[start]:
            yield (parts[start], keys[start]), start, i
            start = i


def _folded(batches: Iterator[pa.RecordBatch], key: str | None, limit: int, entry: dict[int, tuple[int, int]]) -> Iterator[tuple[pa.RecordBatch, list[tuple[tuple, int, _Bins, np.ndarray]]]]:
    """Batches with the runs in them: (chunk and key), the run's place in its chunk, the fold after it, its rows' bins."""
    now, place, fold = None, -1, _Bins(limit)
    for batch in batches:
        sizes = np.nan_to_num(batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        found = []
        for who, a, b in _runs(batch, key):
            if who != now:
                place = place + 1 if now is not None and who[0] == now[0] else 0
                now, fold = who, _Bins(limit)
                if place == 0:
                    fold.total, fold.closed = entry.get(who[0], (0, 0))
            found.append((who, place, fold, fold.run(sizes[a:b])))
        yield batch, found


def greedy_bins(rows: DataFrame, limit: int, key: str | None = "writer", chunks: int | None = None) -> DataFrame:
    """Adds bin: rows in order of seq fill a bin until its bytes reach the limit; the row that crosses it is the bin's last.

    Each key has bins of its own; without a key all rows are one sequence.
    Null sizes count as 0.  Rows that share key and seq are taken in any order.
    """
    scratch = Scratch(rows.sparkSession, "bins")
    table = chunked(rows, key, scratch, chunks)
    kind = table.schema[key].dataType if key else T.StringType()
    facts = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("runs", T.LongType()), T.StructField("total", T.LongType()), T.StructField("closed", T.LongType())])

    def ends(df: DataFrame, entry: dict[int, tuple[int, int]]) -> dict[int, tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for _, found in _folded(batches, key, limit, entry):
                for (part, who), place, fold, _bins in found:
                    first = held[part][1] if part in held else who
                    held[part] = [part, first, who, place + 1, fold.total, fold.closed]
            yield pa.RecordBatch.from_pylist([dict(zip(facts.names, r, strict=True)) for r in held.values()], schema=pa.schema([(f.name, to_arrow_type(f.dataType)) for f in facts]))

        return {r["part"]: tuple(r)[1:] for r in in_order(df.select("_part", *_order(key), "size"), key).mapInArrow(run, facts).collect()}  # a row per chunk

    known = ends(table, {})
    used = {p: (0, 0) for p in known}
    order = sorted(known)

    def entries() -> dict[int, tuple[int, int]]:
        out, before = {}, None
        for p in order:
            first = known[p][0]
            out[p] = known[before][3:] if before is not None and known[before][1] == first else (0, 0)
            before = p
        return out

    rounds = 0
    while True:
        entry = entries()
        # bins that were closed before only add to those of the chunk
        stale = []
        for p in order:
            first, last, runs, total, closed = known[p]
            if entry[p][0] == used[p][0]:
                if runs == 1 and entry[p] != used[p]:
                    known[p] = (first, last, runs, total, closed - used[p][1] + entry[p][1])
                    entry = entries()
                used[p] = entry[p]
            else:
                stale.append(p)
        if not stale:
            break
        chosen = stale if rounds < ROUNDS else stale[:1]
        start = {p: entry[p] for p in chosen}
        known |= ends(table.where(F.col("_part").isin(chosen)), start)
        used |= start
        rounds += 1

    schema, columns = T.StructType([*rows.schema, T.StructField("bin", T.LongType())]), rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _folded(batches, key, limit, entry):
            bins = np.concatenate([b for *_, b in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(bins)], names=[*columns, "bin"])

    return in_order(table, key).mapInArrow(write, schema)


# ---- admission

def admitted(writes: DataFrame, quota: int, key: str = "writer", chunks: int | None = None) -> DataFrame:
    """Adds admitted: writes that would exceed the quota are refused, later smaller ones may still fit.

    ``writes`` has the key, seq, request_id and size.  A write that overwrites
    an admitted one of the same id needs only what it is larger.
    """
    spark, scratch = writes.sparkSession, Scratch(writes.sparkSession, "admission")
    own = Window.partitionBy(key, "request_id").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    known = writes.withColumns({"_prev": F.coalesce(F.lag("size").over(own), F.lit(0)), "_most": F.coalesce(F.max("size").over(before), F.lit(0))})
    table = chunked(known, key, scratch, chunks)
    spanning = [r[key] for r in table.groupBy(key).agg(F.min("_part").alias("a"), F.max("_part").alias("b")).where("a < b").select(key).collect()]  # fewer than chunks
    spans = F.coalesce(F.col(key).isin([k for k in spanning if k is not None]), F.lit(None in spanning)) if spanning else F.lit(False)
    columns = writes.columns
    schema = T.StructType([*writes.schema, T.StructField("admitted", T.BooleanType())])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # keys that lie in one chunk: each is folded where it lies
        owner, used, held = None, 0, {}
        for batch in batches:
            fits = []
            for who, request, size in zip(batch[key], batch["request_id"], batch["size"], strict=True):
                if who != owner:
                    owner, used, held = who, 0, {}
                more = size - held.get(request, 0)
                fits.append(used + more <= quota)
                if fits[-1]:
                    used, held[request] = used + more, size
            yield batch[columns].assign(admitted=fits)

    out = [in_order(table.where(~spans), key).mapInPandas(local, schema)]
    if not spanning:
        return out[0]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for (part, who), g in batch.groupby(["_part", key], dropna=False, sort=False):
                run = np.cumsum(g["size"].to_numpy() - g["_prev"].to_numpy())
                total, most, least = held.get((part, who), (0, 0, np.iinfo(np.int64).max))
                held[part, who] = [total + int(run[-1]), max(most, total + int(run.max())), min(least, int((g["size"] - g["_most"]).min()))]
        yield pd.DataFrame([(p, k, *v) for (p, k), v in held.items()], columns=["part", "key", "total", "most", "least"])

    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", table.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("total", "most", "least"))])
    facts = in_order(table.where(spans).select("_part", key, "seq", "size", "_prev", "_most"), key).mapInPandas(sums, kind).collect()  # a row per chunk and key that spans chunks
    decided: dict[bool, list[tuple]] = {True: [], False: []}
    for who in spanning:
        used, clean, folded = 0, True, []
        mine = F.col(key).eqNullSafe(F.lit(who))
        for f in sorted((f for f in facts if f["key"] == who), key=lambda f: f["part"]):
            place = (f["part"], who)
            if clean and used + f["most"] <= quota:
                used += f["total"]
                decided[True].append(place)
            elif not clean and f["least"] > quota - used:
                decided[False].append(place)
            else:
                part = table.where((F.col("_part") == f["part"]) & mine)
                if clean:  # all before was admitted, so what an id held is its last size
                    start = Window.partitionBy("request_id").orderBy("seq")
                    last = part.withColumn("_n", F.row_number().over(start)).where("_n = 1").select("request_id", F.col("_prev").alias("_held"))
                else:
                    earlier = table.where(mine & F.col("_part").isin([p for p, k in decided[True] if k == who])).select("request_id", "seq", "size") if any(k == who for _, k in decided[True]) else None
                    every = [*([earlier] if earlier is not None else []), *(t.where("admitted").select("request_id", "seq", "size") for t in folded)]
                    seen = every[0]
                    for t in every[1:]:
                        seen = seen.unionByName(t)
                    last = seen.join(part.select("request_id").distinct(), "request_id", "left_semi").groupBy("request_id").agg(F.max_by("size", "seq").alias("_held"))
                room = used

                def fold(batches: Iterator[pd.DataFrame], room=room) -> Iterator[pd.DataFrame]:
                    now, held = room, {}
                    for batch in batches:
                        fits = []
                        for request, size, before in zip(batch["request_id"], batch["size"], batch["_held"], strict=True):
                            more = size - held.get(request, 0 if before != before or before is None else int(before))
                            fits.append(now + more <= quota)
                            if fits[-1]:
                                now, held[request] = now + more, size
                        yield batch[columns].assign(admitted=fits, _used=now)

                ordered = part.join(last, "request_id", "left").select(*columns, "_held").coalesce(1).sortWithinPartitions("seq")
                done = scratch.table(ordered.mapInPandas(fold, T.StructType([*schema, T.StructField("_used", T.LongType())])), "folded")
                end = done.agg(F.max_by("_used", "seq").alias("used"), F.min("admitted").alias("every")).first()
                used, clean = end["used"], clean and end["every"]
                folded.append(done)
        out += [t.select(*columns, "admitted") for t in folded]
    for verdict, places in decided.items():
        if places:
            chosen = F.struct("_part", key).isin([F.struct(F.lit(p).alias("_part"), F.lit(w).cast(table.schema[key].dataType).alias(key)) for p, w in places])
            out.append(table.where(chosen).select(*columns, F.lit(verdict).alias("admitted")))
    found = out[0]
    for t in out[1:]:
        found = found.unionByName(t)
    return found
