"""Spelling variants: words one edit apart, grouped under their commonest form.

A symmetric-delete join: every word emits itself and its distinct single
deletions, and words that share such a key are compared exactly.  Two words
one replacement apart share the key without that place, and of two words one
insertion apart the shorter is a deletion of the longer, so no near pair is
missed.  A key is shared by its insertions alone, whose number the alphabet and
the key's length bound, so no key can hold a share of all words.

Words of up to ``LONG`` code points carry themselves along with their keys.
Longer ones would carry the square of their length; they emit 64-bit hashes of
their deletions, found from running sums, and an 8-byte reference, and meet
their partners' letters only after the join.  Words of ``LONG`` code points go
both ways, for their partners of ``LONG + 1``.

The words are counted before any shuffle in each task, so that frequent ones
cost a row per task, and the counts are written once.  A word's form is its
near word of the largest count (of equal ones the first in the order of code
points), if that is at least ``ratio`` times the word's own.  Counts grow along
forms, so following them ends, after fewer steps than the logarithm of the
largest count; roots are joined to roots, which halves the steps each time.

Null and empty texts have no words.  Rows that share an id and repeated rows
count once each.  An id that is null counts as an empty one where single
letters are taken out.  Texts and words may have any length.  An empty table
gives an empty result.  Only the id and the text are read, so other columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: Letters that a word may have.
LETTERS = "A-Za-zÀ-ÿ"
LEAST, TWICE, RATIO, LONG = 7, 2, 10, 64


def without(word: Column, place: Column) -> Column:
    """``word`` without the code point at ``place``, from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def thinned(run: Column, doc_id: Column, one_in: int = 31) -> Column:
    """``run``, or for one of ``one_in`` pairs of document and run the run without one of its letters."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run))
    return F.when(h % one_in == 0, without(run, (h % F.length(run)).cast("int"))).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """A row (word) for each run of at least ``least`` letters that is left when letters are taken out.

    Shorter runs can't become longer, so they are not split off at all.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    return found.select(thinned(F.col("run"), F.col("id")).alias("word")).where(F.length("word") >= least)


def counted(found: DataFrame, least: int = TWICE) -> DataFrame:
    """word and n of the words that occur at least ``least`` times."""
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def with_keys(vocabulary: DataFrame) -> DataFrame:
    """A row (key, word, n) for each word and each of its distinct deletions."""
    word = F.col("word")
    places = F.sequence(F.lit(0), F.length(word) - 1)
    keys = F.array_union(F.array(word), F.transform(places, lambda i: without(word, i)))
    return vocabulary.select(F.explode(keys).alias("key"), "word", "n")


def deletion_hashes(word: str) -> np.ndarray:
    """64-bit hashes of a word and of its distinct single deletions, in time and memory that grow with its length.

    The hash is a polynomial of the letters in an odd number; what follows a
    deleted letter moves down by one place, which its inverse does.
    """
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = np.uint64(pow(base, -1, 1 << 64))
    letters = (letters + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    letters ^= letters >> np.uint64(29)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(word) - 1, base, np.uint64)]), dtype=np.uint64)
    terms = letters * powers
    upto = np.cumsum(terms, dtype=np.uint64)
    gone = (upto - terms) + (upto[-1] - upto) * inverse
    return np.unique(np.concatenate([gone, upto[-1:]])).view(np.int64)


def long_pairs(vocabulary: DataFrame) -> DataFrame:
    """Near pairs (word, n, other, other_n) in which one word at least has more than ``LONG`` code points."""
    long = vocabulary.where(F.length("word") >= LONG).select("word", "n", F.xxhash64("word").alias("ref"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = deletion_hashes(word)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), ref)), pa.array(np.full(len(keys), len(word) > LONG))], names=["key", "ref", "longer"])

    keys = long.select("ref", "word").mapInArrow(emit, "key long, ref long, longer boolean")
    a, b = keys.toDF("key", "ref", "longer"), keys.toDF("key", "other_ref", "other_longer")
    refs = a.join(b, "key").where("ref <> other_ref AND (longer OR other_longer)").select("ref", "other_ref").distinct()
    other = long.toDF("other", "other_n", "other_ref")
    pairs = refs.join(long.hint("merge"), "ref").join(other.hint("merge"), "other_ref").select("word", "n", "other", "other_n")
    return pairs.where(is_near(F.col("word"), F.col("other")))


def is_near(a: Column, b: Column) -> Column:
    """Exactly one code point inserted, deleted or replaced."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """Each near pair (word, n, other, other_n) once from either side."""
    keys = with_keys(vocabulary.where(F.length("word") <= LONG))
    pairs = keys.join(keys.toDF("key", "other", "other_n").hint("merge"), "key").where("word <> other")
    # two near words share one key only, so no pair comes twice
    return pairs.where(is_near(F.col("word"), F.col("other"))).select("word", "n", "other", "other_n").unionByName(long_pairs(vocabulary))


def forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n_near and the best near word (form, form_n; null where its count is too small) of the words that have a near one."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    found = near_pairs(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    return found.select("word", "n_near", F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to the last one."""
    known = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = stage(known.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    vocabulary = stage(counted(words(docs, id_col, text)), "vocabulary")
    best = stage(forms(vocabulary, ratio), "forms")
    ends = roots(best.where("form IS NOT NULL"))
    out = vocabulary.join(best.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
