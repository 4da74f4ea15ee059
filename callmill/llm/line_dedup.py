"""Line dedup with two Bloom filters, for once-seen and twice-seen hashes.

Two passes over the documents, and one over what is suspected:

1. Tasks hash the keys of their lines, each once per document and, within a
   batch, twice at most.  The hashes (8 bytes each) are dealt to slices by
   their leading bits.  A slice inserts a hash into its once-seen filter, and
   into its twice-seen filter if the first one already held it.  Each slice is
   sized to ``SLICE_HASHES``, so its memory has a bound at any input size.
2. Tasks probe their lines against the twice-seen filters, which are broadcast.
   All of them together take ``filter_bytes`` at most, whatever the input: with
   more repeated lines they answer "perhaps" more often.  Only suspected
   repeats are shuffled: their 128-bit key digests are grouped, which confirms
   them, and give the smallest document id.
3. Lines to drop are gathered per document.  Documents that lose lines are
   joined to them; the others stay where they are.  Which is which tells a
   filter over ids of one hash and ``ID_BITS`` bits; the few that it names
   without cause lose nothing in the join.

A Bloom filter never misses, so the result is exact as long as different keys
have different digests: a false positive is a suspect that the confirmation
clears.

Hot lines are aggregated before they are shuffled, and the join that follows
is a sort-merge join that Spark can split.  Null and empty texts are one empty
line.  Rows that share a document id are one document.  Rows without an id
lose lines that any document with an id holds, and hold none themselves.  An
empty table gives an empty result.  Other columns pass through; names that
begin with ``_drop`` are this module's own.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices as slice_rows
from .common import stage, temporary, with_python_columns

MIN_CHARS = 10
#: Hashes that one slice gets about (8 MB).
SLICE_HASHES = 1 << 20
BITS_PER_HASH = 12
PROBES = 6
#: Bytes of all twice-seen filters together.
FILTER_BYTES = 32 << 20
#: Bits of the filter over ids, in words of 64 that are broadcast.
ID_BITS = 1 << 26
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_TAIL = re.compile(rb"[\x80-\xbf]")


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    key = line.strip(_SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(_TAIL.sub(b"", key)) < min_chars):
        return None
    return key.lower()  # of bytes: A-Z only


def text_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    return [line_key(x, min_chars) for x in (text or "").encode().split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class Bloom:
    """A Bloom filter over 64-bit hashes, a bit array in numpy."""

    def __init__(self, hashes: int = 0, bits: np.ndarray | None = None, most: int | None = None):
        size = max(8, hashes * BITS_PER_HASH // 8 + 1)
        self.bits = np.zeros(size if most is None else max(1, min(size, most)), np.uint8) if bits is None else bits

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step, at = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7) | np.uint64(1), hashes
        for _ in range(PROBES):
            yield at % np.uint64(len(self.bits) * 8)
            at = at + step

    def add(self, hashes: np.ndarray) -> None:
        for place in self._places(hashes):
            np.bitwise_or.at(self.bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self._places(hashes):
            found &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def twice_seen(chunks: list[np.ndarray], most: int | None = None) -> Bloom:
    """The twice-seen filter of a slice, of ``most`` bytes."""
    once, suspects = Bloom(sum(map(len, chunks))), []
    for chunk in chunks:
        values, counts = np.unique(chunk, return_counts=True)
        suspects.append(values[(counts > 1) | once.has(values)])
        once.add(values)
    found = np.unique(np.concatenate(suspects)) if suspects else np.zeros(0, np.uint64)
    twice = Bloom(len(found), most=most)
    twice.add(found)
    return twice


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(slices) >> np.uint64(24)).astype(np.int64)


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def line_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")


def twice_filters(docs: DataFrame, text: str, min_chars: int, filter_bytes: int) -> tuple[dict[int, bytes], int]:
    """The twice-seen filters by slice, and the number of slices."""
    lines = docs.agg(F.sum(line_count(F.col(text)))).first()[0] or 0
    slices = max(8, -(-lines // SLICE_HASHES))
    most = max(1, filter_bytes // slices)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[int] = Counter()
            for t in batch["text"]:
                seen.update({_hash(k) for k in text_keys(t, min_chars) if k is not None})
            values = np.fromiter(seen.keys(), np.uint64, len(seen))
            again = np.fromiter((n > 1 for n in seen.values()), bool, len(seen))
            values = np.concatenate([values, values[again]])
            where = slice_of(values, slices)
            order = np.argsort(where, kind="stable")
            ids, starts = np.unique(where[order], return_index=True)
            parts = np.split(values[order], starts[1:])
            yield pd.DataFrame({"slice": ids, "hashes": [p.tobytes() for p in parts[: len(ids)]]})

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        twice = twice_seen([np.frombuffer(h, np.uint64) for h in group["hashes"]], most)
        return pd.DataFrame({"slice": [key[0]], "filter": [twice.bits.tobytes()]})

    dealt = docs.select(F.col(text).alias("text")).mapInPandas(hashes, "slice long, hashes binary")
    built = dealt.groupBy("slice").applyInPandas(build, "slice long, filter binary")
    return {r["slice"]: bytes(r["filter"]) for r in built.toLocalIterator()}, slices


def suspected(docs: DataFrame, id_col: str, text: str, min_chars: int, filter_bytes: int) -> DataFrame:
    """_id and _key (digest) of each line that the twice-seen filters hold, once per document."""
    held, slices = twice_filters(docs, text, min_chars, filter_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(held)
    kind = docs.schema[id_col].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = {k: Bloom(bits=np.frombuffer(v, np.uint8)) for k, v in sent.value.items()}
        for batch in slice_rows(batches):
            at, keys, values = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k in {k for k in text_keys(t, min_chars) if k is not None}:
                    at.append(i)
                    keys.append(k)
                    values.append(_hash(k))
            hashes = np.array(values, np.uint64)
            keep, where = np.zeros(len(hashes), bool), slice_of(hashes, slices)
            for s in np.unique(where):
                if s in blooms:
                    keep[where == s] = blooms[s].has(hashes[where == s])
            chosen = np.flatnonzero(keep)
            ids = batch.column(0).take(pa.array(np.array(at, np.int64)[chosen]))
            marks = pa.array([digest(keys[i]) for i in chosen], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, marks], names=["_id", "_key"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).mapInArrow(probe, f"_id {kind}, _key binary")


def id_place(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(ID_BITS))


def with_mark(docs: DataFrame, id_col: str, drops: DataFrame) -> DataFrame:
    """``docs`` with _drop_maybe, which is true for all ids of ``drops`` and few others."""
    places = drops.select(id_place(F.col("_drop_id")).alias("_drop_place"))
    words = places.select(F.shiftright("_drop_place", 6).alias("_drop_word"), F.expr("shiftleft(1L, cast(_drop_place % 64 AS int))").alias("bit")).groupBy("_drop_word").agg(F.bit_or("bit").alias("_drop_bits"))
    # ID_BITS bounds these rows
    placed = docs.withColumn("_drop_place", id_place(F.col(id_col))).join(F.broadcast(words), F.shiftright("_drop_place", 6) == F.col("_drop_word"), "left")
    found = F.expr("shiftright(_drop_bits, cast(_drop_place % 64 AS int))").bitwiseAND(F.lit(1)) == 1
    return placed.withColumn("_drop_maybe", F.coalesce(found, F.lit(False))).drop("_drop_word", "_drop_bits", "_drop_place")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The columns of ``docs`` with kept_text, n_lines and n_dropped.

    A line whose key has ``min_chars`` code points at least stays only in the
    document with the smallest id of those that hold it.
    """
    with temporary(docs.sparkSession):
        lines = stage(suspected(docs, id_col, text, min_chars, filter_bytes), "suspects")
        # written, so that the join reads both of its sides from exchanges of its own, which Spark can split
        first = stage(lines.groupBy("_key").agg(F.min("_id").alias("_first")).where("_first IS NOT NULL"), "first")
        repeats = lines.join(first.hint("merge"), "_key").where(~F.col("_id").eqNullSafe(F.col("_first")))
        drops = stage(repeats.groupBy(F.col("_id").alias("_drop_id")).agg(F.collect_set("_key").alias("_drop")), "drops", keep=True)
    marked = with_mark(docs, id_col, drops)
    losing = marked.where("_drop_maybe").drop("_drop_maybe")
    joined = losing.join(drops.hint("merge"), losing[id_col].eqNullSafe(drops["_drop_id"]), "left")

    def cut(texts: list, dropped: list) -> list:
        kept_texts, counts, gone = [], [], []
        for t, drop in zip(texts, dropped, strict=True):
            kept = lines = (t or "").encode().split(b"\n")
            if drop is not None:
                lost = set(drop)
                kept = [x for x in lines if (k := line_key(x, min_chars)) is None or digest(k) not in lost]
            kept_texts.append(b"\n".join(kept).decode())
            counts.append(len(lines))
            gone.append(len(lines) - len(kept))
        return [kept_texts, counts, gone]

    added = [("kept_text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]
    changed = with_python_columns(joined, [text, "_drop"], cut, added, drop=("_drop_id", "_drop"))
    others = [F.col(c) for c in docs.columns if c not in {n for n, _ in added}]
    same = marked.where("NOT _drop_maybe").select(*others, F.coalesce(text, F.lit("")).alias("kept_text"), line_count(F.col(text)).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return changed.unionByName(same)
