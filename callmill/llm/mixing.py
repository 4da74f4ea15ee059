"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a keyed digest and laid end to end,
again and again up to ``MAX_REPEATS`` times.  A copy's virtual finish time is
the source's words up to its end divided by the source's weight; its virtual
middle is half its size before that.  All copies of all sources together, in
the order of these times, are cut where the total budget is spent: at the cut
each source has been served in proportion to its weight, unless it ran out of
copies before.

The cut is the virtual time ``v`` with  sum(min(repeats * size, weight * v)) =
budget, the sum of what all sources have been served by then.  With sources in
the order in which they run out, it is the greatest of (budget - what the ones
before have in all) / (weight of the others): the terms grow as long as the
next source runs out before them, and fall from there on.  A copy is taken when
its virtual middle lies at the cut or before.  So the mix is a prefix of the
global order by virtual middles, ties at the cut included, and a source misses
its target by half a document at most: what it takes ends within half a
document of ``weight * v``, or is all of its copies.

Running sums never gather a source in one task: documents are dealt to buckets
of the digest, bucket totals are summed first, and each bucket adds what lies
before it.  Only ids, sizes, sources and hashes are moved.  One row per source
passes through one task, which ranks the sources.

Null texts have size 0; the null source is a source of its own, the last one.
Repeated rows are documents of their own (ties in the digest are ordered by
id, size and text).  Rows without an id are shuffled by their text.  Tables
that are empty or hold no words give targets and takes of 0.  Only the three
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents that one bucket holds about.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when(text.isNull(), 0).otherwise(words).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """A row per source: source, source_id, weight, source_size, n_docs, cut (the same for all) and target.

    The sources rank by code point, null last, and take the weights in turn.
    """
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = sources.withColumn("source_id", F.row_number().over(by_rank) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int")).cast("long"))
    cap, every = F.col("source_size") * repeats, Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(cap.cast("double") / F.col("weight"), F.col("source_id")).rowsBetween(Window.unboundedPreceding, -1)
    spent, gone = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in (cap, F.col("weight")))
    total = F.sum("source_size").over(every) if budget is None else F.lit(budget)
    share = (total - spent).cast("double") / (F.sum("weight").over(every) - gone)
    sources = sources.withColumn("share", share).withColumn("cut", F.greatest(F.max("share").over(every), F.lit(0.0))).drop("share")
    return stage(sources.withColumn("target", F.least(F.lit(float(repeats)) * F.col("source_size"), F.col("weight") * F.col("cut"))), "sources")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: str = "mix", budget: int | None = None) -> DataFrame:
    """A row per document: id, source, size, source_size, target, cut, weight, finish (virtual finish time of its first copy), copies, taken and text_hash.

    Rows come range-sorted by finish time.  ``taken`` is ``size * copies``.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"), F.md5(F.concat(F.lit(seed), F.lit(":"), key)).alias("digest"))
    sized = stage(sized, "sizes")
    sources = source_targets(sized, weights, repeats, budget)
    total = sources.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_ROWS))
    placed = sized.withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long"))
    dims = sources.select(F.col("source").alias("dim_source"), "source_id", "weight", "source_size", "cut", "target")
    placed = placed.join(dims, placed["source"].eqNullSafe(dims["dim_source"])).drop("dim_source")
    sums = placed.groupBy("source_id", "bucket").agg(F.sum("size").alias("bucket_size"))
    so_far = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_id", "bucket", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_id", "bucket").orderBy("digest", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = placed.withColumn("within", F.sum("size").over(inside)).join(offsets, ["source_id", "bucket"])
    end = F.col("offset") + F.col("within")
    copies = sum((F.when(F.col("source_size") * e + end - F.col("size") / 2 <= F.col("weight") * F.col("cut"), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    out = served.select("id", "source", "size", "source_size", "target", "cut", "weight", (end / F.col("weight")).alias("finish"), copies.cast("long").alias("copies"), "text_hash")
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    return out.repartitionByRange(F.col("finish"), F.col("id")).sortWithinPartitions("finish", "id").withColumnRenamed("id", id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with copy_no and finish_time, in the order of finish times.

    Rows are told apart by id, source and text.  Rows that have all three in
    common lie side by side in the order, so they are taken equally often, but
    for those of which only the first ones lie before the cut: these few are
    numbered, and it does not matter which of them comes first.  Columns of
    ``docs`` that are named copy_no or finish_time are replaced.
    """
    key = ["_mix_id", "_mix_none", "_mix_source", "_mix_nowhere", "_mix_hash"]

    def keyed(id_: str, source_: str, hash_: Column) -> list[Column]:
        values = (F.coalesce(F.col(id_).cast("string"), F.lit("")), F.col(id_).isNull(), F.coalesce(source_, F.lit("")), F.col(source_).isNull(), hash_)
        return [c.alias(n) for c, n in zip(values, key, strict=True)]

    takes = mix_sources(docs, id_col, text, source, **options)
    takes = takes.select(*keyed(id_col, "source", F.col("text_hash")), "copies", "finish", (F.col("source_size") / F.col("weight")).alias("_mix_round"))
    takes = takes.groupBy(*key).agg(F.max("copies").alias("_mix_copies"), F.count("*").alias("_mix_rows"), F.sum("copies").alias("_mix_all"), F.min("finish").alias("_mix_finish"), F.max("_mix_round").alias("_mix_round"))
    takes = stage(takes.where("_mix_copies > 0"), "takes")
    named = docs.select(*docs.columns, *keyed(id_col, source, F.xxhash64(text)))
    cut_off = takes.where("_mix_copies * _mix_rows > _mix_all")
    whole = named.join(takes.where("_mix_copies * _mix_rows = _mix_all").hint("merge"), key)
    if not cut_off.isEmpty():
        part = named.join(cut_off.hint("merge"), key).withColumn("_mix_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
        least = F.floor(F.col("_mix_all") / F.col("_mix_rows"))
        more = F.col("_mix_n") <= F.col("_mix_all") - least * F.col("_mix_rows")
        part = part.withColumn("_mix_copies", least + more.cast("long")).drop("_mix_n").where("_mix_copies > 0")
        whole = whole.unionByName(part)
    copies = whole.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), (F.col("_mix_copies") - 1).cast("int"))))
    finish = F.col("_mix_finish") + F.col("_mix_copy") * F.col("_mix_round")
    kept = [c for c in docs.columns if c not in ("copy_no", "finish_time")]
    out = copies.select(*kept, F.col("_mix_copy").alias("copy_no"), finish.alias("finish_time"))
    return out.repartitionByRange("finish_time", id_col).sortWithinPartitions("finish_time", id_col)
