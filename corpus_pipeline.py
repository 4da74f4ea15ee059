"""From raw documents to a training mix: each stage works on what the one before it kept.

A stage reads doc_id, text and source by name; all other columns pass through,
whatever their names.  Null and empty texts and rows without an id go through
every stage like others, and empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmill.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from callmill.llm.common import read, stage, temporary
from callmill.llm.queries import toxicity_network


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that none has the name of an operator's result."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("others"))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that ``packed`` put away, with new values for those named."""
    held = {c: F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c) for c in columns} | {c: v for c, v in new.items() if c in columns}
    return rows.select(*(v.alias(c) for c, v in held.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go."""
    scored = toxicity.score(packed(docs), None if docs.isEmpty() else toxicity_network(docs, read(spark, sf_dir, "labels")))
    return unpacked(scored.where("predicted = 0"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay, with fewer lines.  A null text becomes an empty one."""
    cut = line_dedup.dedup_lines(packed(docs))
    return unpacked(cut, docs.columns, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words a shingle, a similarity of 0.8) the document with the smallest id stays.

    Rows that share an id are judged by their own texts; of rows that have id
    and text in common the first by their other columns stays.  Rows without an
    id stay.
    """
    kept = stage(minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct(), "kept")
    named = packed(docs.where("doc_id IS NOT NULL"))
    named = named.join(kept.hint("merge"), (named["doc_id"] == kept["kept_id"]) & (F.xxhash64(named["text"]) == kept["kept_hash"]), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text"), F.length("text")).orderBy("text", F.to_json("others"))
    named = unpacked(named.withColumn("place", F.row_number().over(same)).where("place = 1"), docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    bad = stage(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    bad = decontaminate.sized(bad, F.lit(16))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, each document as often as it is taken, in the order of finish times."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
#: The network and the fingerprints have no counterpart in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with temporary(spark):
            docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
