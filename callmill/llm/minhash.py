"""Near-duplicate documents by one-permutation MinHash.

A document is the set of its distinct word shingles, as 64-bit hashes.  One
hash function deals the set into ``BINS`` bins and keeps each bin's least
value; an empty bin borrows from the first filled one in a fixed random order
of its own (optimal densification).  ``BANDS`` bands of ``ROWS`` bins give the
buckets that similar documents share: at a similarity of 0.8 a pair misses all
of them with a probability of about 5e-6.

Equal sets are one class with one representative, so copies never meet in a
bucket.  Each bucket gives star-shaped candidate edges, from its members to a
centre only: the first member in one of ``ORDERS``, which the bucket picks.  A
bucket of n members so costs n - 1 edges, not n * (n - 1) / 2.  Edges are
confirmed on full sets, and the smallest id that a document reaches over
confirmed edges is its component.

Where a bucket's members end up in several components, its star may have
missed a link between two members that are not the centre.  Such a bucket, once
for all buckets with the same members, is cut into blocks of about ``BLOCK``
members.  Members of one component that fill a block or more get blocks of
their own.  Every two blocks are compared in one task, unless they hold one
component only: products of 0/1 matrices give the sizes of all intersections,
and a task returns as many links as connect what it found connected, at most
one per component.  After that, every two documents that share a bucket are in
one component or have been compared on their full sets: no link between them is
lost.  The work grows with the square of the blocks only in buckets whose
members are alike and yet in many components.

Buckets are aggregated before they are joined back, and all joins are
sort-merge joins that Spark can split, so a group with a third of all rows
does not land in one task.  Components are found by DataFrame iteration;
links, components and fingerprints stay out of the driver.

Null, empty and wordless texts have no shingles and no links.  Ids are
integers.  Of different texts under one id, the one with the smallest hash is
compared, if the id is its class's smallest; each row has its own n_shingles
and the component of its own text.  Rows without an id are each on their own:
no component, kept.  Only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stage, temporary

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Members of a block, and columns of the matrices that are multiplied at once.
BLOCK, COLUMNS = 256, 4096
#: Random orders of ids: an id's place is the id XOR one of these.
ORDERS = (0x2C9A5E1B7D3F4086, 0x51E3C7A90B6D2F18, 0x0F8B43D6E95A7C21, 0x73D1A6084CE2B59F)
#: Links that one file of the component search holds about.
LINKS_AT_ONCE = 250_000
#: Words of a shingle, and the least similarity of a link.
SHINGLE = 5
MIN_PERCENT = 80
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: An odd multiplier for each place in a shingle.
_PLACES = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes.

    Words are what ASCII white space separates, A-Z lowered; a text of fewer
    words than a shingle has is one shingle.
    """

    #: Words whose hashes are kept; beyond it the memory starts anew.
    KNOWN = 300_000

    def __init__(self, words: int = SHINGLE):
        if not 1 <= words <= len(_PLACES):
            raise ValueError(f"1 to {len(_PLACES)} words a shingle")
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.KNOWN:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(ids) - self.words + 1)
        width = min(self.words, len(ids))
        total = np.full(n, width, np.uint64)
        for i in range(width):  # words' hashes are random, so different sequences of them hardly ever have equal sums
            total += ids[i : i + n] * _PLACES[i]
        return np.unique(mixed(total))


def borrow_order(bins: int = BINS, seed: int = 5) -> np.ndarray:
    """For each bin, the rank of every other bin in its order of borrowing."""
    ranks = np.random.default_rng(seed).random((bins, bins))
    return ranks.argsort(1).argsort(1).astype(np.uint16)


def signature(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One-permutation hashing with optimal densification."""
    bins = len(order)
    # bins are ranges of the hashes, so in ascending order the first hash of each bin is its least
    hashes = np.sort(mixed(shingles + np.uint64(0x5851F42D4C957F2D)))
    where = ((hashes >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    filled = where[first]
    sig = np.empty(bins, np.uint64)
    sig[filled] = hashes[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        sig[empty] = sig[filled[order[np.ix_(empty, filled)].argmin(1)]]
    return sig


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.reshape(-1, rows)
    total = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        total = mixed(total * _MIX + bands[:, i])
    return total


def fingerprints(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """id, n_shingles, set_hash (128 bits of the whole set), bands (an array) and text_hash."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, order = Shingler(words), borrow_order()
        for batch in slices(batches):
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            bands = [band_hashes(signature(s, order)).view(np.int64) if len(s) else None for s in sets]
            arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_shingles", "set_hash", "bands", "text_hash"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return texts.mapInArrow(run, f"id {kind}, n_shingles long, set_hash binary, bands array<long>, text_hash long")


def spelled(edges: DataFrame, docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """id and set (as bytes) of all ends of the edges."""
    kind = docs.schema[id_col].dataType.simpleString()
    ends = edges.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(ends.hint("merge"), F.col("id") == F.col("end"), "left_semi")
    # the join has dealt and sorted the rows by id
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text")))).where("n = 1").select("id", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in slices(batches):
            sets = [shingle(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return stage(texts.mapInArrow(spell, f"id {kind}, set binary"), "sets")


def confirmed(edges: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    kind = sets.schema["id"].dataType.simpleString()
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    pairs = edges.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            good = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= min_percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(compare, f"a {kind}, b {kind}")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the smallest node it reaches), by alternating large and small stars."""
    links = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        few = max(4, links.count() // LINKS_AT_ONCE)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, like the one below, so that a node with a third of all links can be split in the join
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(few), name)
        # large star: larger neighbours hang onto the least of the neighbourhood
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large.coalesce(few), name)
        # small star: a node and its smaller neighbours hang onto the least of them
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few), name)
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        links = stage(small.where("u <> v").distinct().coalesce(few), name)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)


def order_of(bucket: str) -> Column:
    return F.element_at(F.array(*map(F.lit, ORDERS)), (F.pmod(bucket, F.lit(len(ORDERS))) + 1).cast("int"))


def starred(members: DataFrame) -> DataFrame:
    """``members`` (bucket, id) that aren't their bucket's centre, with the centre c."""
    place = F.col("id").bitwiseXOR(order_of("bucket"))
    centres = members.groupBy("bucket").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1")
    # written, so that the join reads both of its sides from exchanges of its own, which Spark can split
    centres = stage(centres.select("bucket", F.col("place").bitwiseXOR(order_of("bucket")).alias("c")), "centres")
    return members.join(centres.hint("merge"), "bucket").where("id <> c")


def edges_of(stars: DataFrame) -> DataFrame:
    return stars.select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE, min_percent: int = MIN_PERCENT) -> DataFrame:
    """id, n_shingles, component_id, kept (the id is the component's smallest) and text_hash."""
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    prints = stage(fingerprints(docs, id_col, text, words), "fingerprints")
    classes = prints.where("id IS NOT NULL AND n_shingles > 0").groupBy("set_hash").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    classes = stage(classes, "classes")
    with temporary(docs.sparkSession):
        stars = stage(starred(classes.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))).select("bucket", "id", "c"), "stars")
        edges = stage(edges_of(stars), "edges")
        sets = spelled(edges, docs, id_col, text, words)
        links = stage(confirmed(edges, sets, min_percent), "links")
        more = stage(compared(in_blocks(mixed_members(stars, components(links))), sets, min_percent), "links")
        roots = components(links) if more.isEmpty() else components(links.unionByName(more))
        roots = stage(roots, "roots", keep=True)
    return labelled(prints, classes, roots, id_col)


def mixed_members(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, id and root of the members of buckets with several components and a pair that was not compared; one bucket of those with the same members."""
    of_id, of_c = (roots.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("id", "id_root"), ("c", "c_root")))
    rooted = stars.join(of_id.hint("merge"), "id", "left").join(of_c.hint("merge"), "c", "left")
    rooted = stage(rooted.select("bucket", "id", "c", F.coalesce("id_root", "id").alias("root"), F.coalesce("c_root", "c").alias("c_root")), "rooted")
    # two hashes, so that equal ones mean equal members
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).bitwiseXOR(F.min(F.xxhash64("c", F.lit(k)))).alias(f"mark{k}") for k in (1, 2)]
    mixed = rooted.groupBy("bucket").agg(F.max(F.col("root") != F.col("c_root")).alias("odd"), F.count("*").alias("others"), *marks).where("odd AND others > 1")
    mixed = stage(mixed.groupBy("mark1", "mark2", "others").agg(F.min("bucket").alias("bucket")).select("bucket"), "mixed")
    kept = rooted.join(mixed.hint("merge"), "bucket", "left_semi")
    centres = kept.groupBy("bucket").agg(F.min("c").alias("id"), F.min("c_root").alias("root"))
    return stage(kept.select("bucket", "id", "root").unionByName(centres), "members")


def in_blocks(members: DataFrame) -> DataFrame:
    """id, root, pair (of two blocks of a bucket) and side, for all pairs of blocks that hold several components."""
    held = stage(members.groupBy("bucket", "root").agg(F.count("*").alias("n")), "held")
    own = F.col("n") >= BLOCK
    rest = stage(held.groupBy("bucket").agg(F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("rest")), "rest")
    # one component alone is told from the others by its root, and cut by id; the others are dealt by root
    cut = held.join(rest.hint("merge"), "bucket").select("bucket", "root", own.alias("own"), F.ceil(F.when(own, F.col("n")).otherwise(F.col("rest")) / BLOCK).alias("parts"))
    placed = members.join(stage(cut, "cut").hint("merge"), ["bucket", "root"])
    part = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("id")).otherwise(F.col("root"))), F.col("parts"))
    placed = stage(placed.select("bucket", "id", "root", F.when(F.col("own"), F.col("root")).alias("alone"), part.alias("part")), "placed")
    blocks = stage(placed.select("bucket", "alone", "part").distinct(), "blocks")
    key = F.struct(F.coalesce("alone", F.lit(-1)).alias("alone"), F.col("alone").isNull().alias("several"), "part")
    blocks = blocks.select("bucket", "alone", key.alias("x"))
    other = blocks.select("bucket", F.col("alone").alias("alone2"), F.col("x").alias("y"))
    pairs = blocks.join(other.hint("merge"), "bucket").where("x <= y AND NOT coalesce(alone = alone2, false)")
    pairs = stage(pairs.select("bucket", "x", "y", F.concat_ws(":", "bucket", "x.alone", "x.several", "x.part", "y.alone", "y.several", "y.part").alias("name")), "pairs")
    sides = pairs.select("bucket", F.col("x").alias("block"), "name", F.lit(0).alias("side")).unionByName(pairs.where("x <> y").select("bucket", F.col("y").alias("block"), "name", F.lit(1).alias("side")))
    return placed.withColumn("block", key).join(sides.hint("merge"), ["bucket", "block"]).select("id", "root", F.col("name").alias("pair"), "side")


def compared(rows: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """Links (a, b) that connect the components of each pair of blocks, by exact comparison of all sets of different components."""
    joined = rows.join(sets.hint("merge"), "id").repartition("pair").sortWithinPartitions("pair", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield edge_batch(links_between(held, min_percent))
                    held = []
                held.append(row)
        if held:
            yield edge_batch(links_between(held, min_percent))

    return joined.select("pair", "side", "id", "root", "set").mapInArrow(run, "a long, b long")


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(e) for e in edges], pa.int64()), pa.array([min(e) for e in edges], pa.int64())], names=["a", "b"])


def links_between(rows: list[tuple], min_percent: int) -> list[tuple[int, int]]:
    """Of (pair, side, id, root, set) rows in the order of sides: links across the sides (or inside the only one) that connect different roots."""
    first = sum(r[1] == 0 for r in rows)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    lengths, roots = np.array([len(x) for x in sets]), np.array([r[3] for r in rows])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), lengths)
    common = np.cumsum(count > 1) - 1  # of what one set alone holds, nothing is shared
    shared = count[place] > 1
    owner, place = owner[shared], common[place[shared]]
    left, right = slice(0, first), slice(first, None) if first < len(rows) else slice(0, first)
    both = np.zeros((len(roots[left]), len(roots[right])), np.int64)
    for at in range(0, int(place.max(initial=-1)) + 1, COLUMNS):
        here = (place >= at) & (place < at + COLUMNS)
        held = np.zeros((len(rows), COLUMNS), np.float32)
        held[owner[here], place[here] - at] = 1
        both += (held[left] @ held[right].T).astype(np.int64)
    alike = 100 * both >= min_percent * (lengths[left][:, None] + lengths[right][None, :] - both)
    alike &= roots[left][:, None] != roots[right][None, :]
    top = {r: r for r in roots.tolist()}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    shift = first if first < len(rows) else 0
    for i, k in zip(*np.nonzero(alike), strict=True):
        x, y = find(rows[i][3]), find(rows[k + shift][3])
        if x != y:
            top[x] = y
            out.append((rows[i][2], rows[k + shift][2]))
    return out


def labelled(prints: DataFrame, classes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    of_class = classes.join(roots.hint("merge"), classes["rep"] == roots["node"], "left").select("set_hash", F.coalesce("root", "rep").alias("root"))
    out = prints.select("id", "n_shingles", "set_hash", "text_hash").join(of_class.hint("merge"), "set_hash", "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("root", "id"))
    out = out.select(F.col("id"), "n_shingles", component.alias("component_id"), "text_hash")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
