"""Benchmark decontamination over a distributed positional inverted index.

Benchmark items are cut into windows of consecutive words.  A first pass over
the training documents counts the windows' terms.  A second one stores the
postings (term, document, positions) of each window's two rarest terms, which
are all that the search reads.  A window's two lists, each less the term's
offset in the window, are intersected per document; what is left are start
positions, rarest terms first.  The window's other words are then compared
with the words at these starts, in the few documents that have any, so matches
are exact phrases.  ``proximity_matches`` finds all terms of a phrase within a
span of words instead, from the same kind of index.

Everything is DataFrame operations.  Terms and candidate ids are broadcast
only while their measured size is under ``BROADCAST_BYTES``; beyond it they
are joined by sort-merge.  Index rows are one per term and document, so a
frequent term is never gathered in one group.

Null texts and texts without words have no words and no hits.  Rows are told
apart by id and text: repeated rows get equal values, and rows that share an
id only are judged by their own text.  Null ids are kept; items without an id
are not counted.  Without documents or items the result is empty or clean.
Only ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stage

WINDOW = 13
#: A document is contaminated from this many hit words in a hundred.
MIN_PERCENT = 5
BROADCAST_BYTES = 16 << 20
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """The words of a text as they stand."""
    return F.array_remove(F.split(text, BETWEEN), "")


def exact_words(text: Column) -> Column:
    """The words of a text, A-Z lowered."""
    return F.transform(raw_words(text), ascii_lower)


def folded(word: Column) -> Column:
    """A term: equal for words that are equal with A-Z lowered, and for some more, which the exact comparison tells apart.

    It depends on the word alone, never on what stands around it.
    """
    return F.lower(word)


def sized(df: DataFrame, width: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, with a hint to broadcast it if it is small enough, else to merge."""
    size = df.agg(F.sum(width + 32)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df.hint("merge")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id and win (an array of words) of every window; a shorter item is one window."""
    words = items.select(F.col(item_id).alias("item_id"), exact_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    wins = F.transform(starts, lambda i: F.slice("w", i, window))
    return words.select("item_id", F.explode(wins).alias("win"))


def term_counts(docs: DataFrame, terms: DataFrame, text: str, limit: int) -> DataFrame:
    """term and its number of occurrences in all documents, for the terms that occur."""
    tokens = docs.select(F.explode(raw_words(F.col(text))).alias("word")).select(folded(F.col("word")).alias("term"))
    return tokens.join(sized(terms, F.octet_length("term"), limit), "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str, text: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The index: term, id, h (hash of the text), n_words, positions (ascending, from 0).

    The empty term stands at position -1 of every document, so that each one
    has a row with its number of words.
    """
    every = stage(terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct(), "terms")
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.coalesce(raw_words(F.col(text)), F.array().cast("array<string>")).alias("w"))
    tokens = words.select("id", "h", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
    tokens = tokens.select("id", "h", "n_words", "pos", folded(F.col("word")).alias("term"))
    held = tokens.join(sized(every, F.octet_length("term"), limit), "term")
    lists = held.groupBy("term", "id", "h", "n_words").agg(F.sort_array(F.collect_set(F.col("pos") - 1)).alias("positions"))
    return stage(lists, "postings")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, min_percent: int = MIN_PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document: id, n_words, n_hit, items (sorted ids as strings), contaminated, and matches (win_start, win_words)."""
    per_item = stage(item_windows(items, item_id, item_text, window).withColumn("win_id", F.xxhash64(F.concat_ws(" ", "win"))), "windows")
    wins = per_item.select("win_id", "win").dropDuplicates(["win_id"])
    placed = wins.select("win_id", F.posexplode("win").alias("offset", "word")).select("win_id", "offset", folded(F.col("word")).alias("term"))
    counts = term_counts(docs, stage(placed.select("term").distinct(), "terms"), text, broadcast_bytes)
    # windows with a term that no document holds occur nowhere
    found = placed.join(stage(counts, "counts"), "term", "left")
    rare = found.withColumn("rank", F.row_number().over(Window.partitionBy("win_id").orderBy(F.coalesce("n", F.lit(0)), "offset"))).where("rank <= 2")
    rare = rare.groupBy("win_id").agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("term", "offset")), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0")
    anchors = stage(rare.drop("least"), "anchors")
    index = postings(docs, anchors.select(F.explode(F.array_compact(F.array("term1", "term2"))).alias("term")).distinct(), id_col, text, broadcast_bytes)

    def starts(r: int) -> DataFrame:
        side = sized(anchors.where(F.col(f"term{r}").isNotNull()).select("win_id", F.col(f"term{r}").alias("term"), F.col(f"offset{r}").alias("offset")), F.octet_length("term"), broadcast_bytes)
        return index.where("term <> ''").join(side, "term").select("win_id", "id", "h", F.transform("positions", lambda p: p - F.col("offset")).alias(f"s{r}"))

    lone = anchors.where("term2 IS NULL").select("win_id")
    first, second = starts(1), starts(2).withColumnsRenamed({"win_id": "win2", "id": "id2", "h": "h2"})
    same = (F.col("win_id") == F.col("win2")) & F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    met = first.join(second.hint("merge"), same).select("win_id", "id", "h", F.array_intersect("s1", "s2").alias("s"))
    met = met.unionByName(first.join(F.broadcast(lone) if lone.isEmpty() else lone, "win_id", "left_semi").select("win_id", "id", "h", F.col("s1").alias("s")))
    met = met.select("win_id", "id", "h", F.filter("s", lambda p: p >= 0).alias("s")).where(F.size("s") > 0)
    dims = sized(stage(wins, "windows"), F.octet_length(F.concat_ws(" ", "win")), broadcast_bytes)
    tried = stage(met.join(dims, "win_id"), "candidates")
    held = sized(stage(tried.select("id", "h").distinct(), "candidates"), F.lit(16), broadcast_bytes)
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("doc_h"), F.col(text).alias("t"))
    texts = texts.join(held, texts["doc"].eqNullSafe(held["id"]) & (texts["doc_h"] == held["h"]), "left_semi").dropDuplicates(["doc", "doc_h"]).select("doc", "doc_h", exact_words(F.col("t")).alias("w"))
    pairs = tried.join(texts.hint("merge"), tried["id"].eqNullSafe(texts["doc"]) & (tried["h"] == texts["doc_h"]))
    true = pairs.select("id", "h", "win_id", F.size("win").alias("n"), F.filter("s", lambda p: F.slice("w", p + 1, F.size("win")) == F.col("win")).alias("s")).where(F.size("s") > 0)
    true = stage(true, "matches")
    spans = true.groupBy("id", "h").agg(F.array_sort(F.flatten(F.collect_list(F.transform("s", lambda p: F.struct(p.alias("a"), (p + F.col("n")).alias("b")))))).alias("spans"))
    union = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")), lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("hit")))["hit"]
    owners = true.select("id", "h", "win_id").join(per_item.where("item_id IS NOT NULL").select("win_id", F.col("item_id").cast("string").alias("item")).distinct(), "win_id")
    named = owners.groupBy("id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = spans.withColumn("n_hit", union).join(named, F.expr("true") & spans["id"].eqNullSafe(named["id"]) & (spans["h"] == named["h"]), "left").select(spans["id"].alias("hit_id"), spans["h"].alias("hit_h"), "n_hit", "items", "spans")
    sizes = index.where("term = ''").select("id", "h", "n_words")
    # the index has a row per distinct row of docs; docs may repeat them
    repeats = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text).alias("row_h")).groupBy("row_id", "row_h").agg(F.count("*").alias("copies"))
    rows = sizes.join(hits, sizes["id"].eqNullSafe(hits["hit_id"]) & (sizes["h"] == hits["hit_h"]), "left")
    rows = rows.join(repeats.where("copies > 1"), rows["id"].eqNullSafe(F.col("row_id")) & (rows["h"] == F.col("row_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = rows.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (100 * n_hit >= min_percent * F.col("n_words"))).alias("contaminated"), F.col("h").alias("text_hash"), "spans", F.coalesce("copies", F.lit(1)).alias("_copies"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copy", "_copies")


def proximity_matches(docs: DataFrame, phrases: DataFrame, within: int, id_col: str = "doc_id", text: str = "text", phrase_id: str = "item_id", phrase_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, item_id and start where all distinct words of a phrase, letters lowered, lie within ``within`` words from the start on.

    A start is a position of one of these words.  Each position looks ahead
    over ``within`` positions at most, whatever the number of occurrences.
    """
    terms = phrases.select(F.col(phrase_id).alias("item_id"), F.array_distinct(F.transform(raw_words(F.col(phrase_text)), folded)).alias("w")).where(F.size("w") > 0)
    each = stage(terms.select("item_id", F.size("w").alias("n_terms"), F.explode("w").alias("term")), "terms")
    index = postings(docs, each.select("term").distinct(), id_col, text, broadcast_bytes)
    places = index.where("term <> ''").join(sized(each, F.octet_length("term"), broadcast_bytes), "term").select("item_id", "n_terms", "id", "h", "term", F.explode("positions").alias("pos"))
    ahead = Window.partitionBy("item_id", "id", "h").orderBy("pos").rangeBetween(0, within - 1)
    full = places.withColumn("near", F.size(F.collect_set("term").over(ahead))).where("near = n_terms")
    return full.select(F.col("id").alias(id_col), "item_id", F.col("pos").alias("start")).distinct()
