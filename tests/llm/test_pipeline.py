"""Queries against SQL on a small table, and each stage of the pipeline against a plain version."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callmill.llm import queries, toxicity

from ..compare import connect, rows
from . import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    want = connect(SF).execute(queries.ORACLE_SQL[name]).df()
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]

    def run(name, df):
        out = stages[name](spark, df, SF).cache()
        if name != "mixing":
            assert out.columns == docs.columns
        return out

    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    clean = run("toxicity", docs)
    assert 0.6 * docs.count() < clean.count() < docs.count()
    before = texts(clean)
    lines = run("line dedup", clean)
    assert texts(lines) == {d: t for d, (_, _, t) in plain.deduped(before.items()).items()}
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0
    before = texts(lines)
    near = run("near dedup", lines)
    assert set(texts(near)) == {d for d, (_, c) in plain.components(before.items(), n=5).items() if c == d}
    before = texts(near)
    fresh = run("decontamination", near)
    assert set(texts(fresh)) == {d for d, found in plain.contamination(before.items(), items).items() if not found[3]}
    mixed = run("mixing", fresh)
    size = {d: len((t or "").split()) for d, t in texts(fresh).items()}
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(copies.values()) <= 3
    assert abs(sum(size[d] * n for d, n in copies.items()) - sum(size.values())) <= 0.1 * sum(size.values())


@pytest.fixture
def edges(spark, tmp_path):
    """A folder with labels and benchmark, and documents with every awkward row."""
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "tiny item of four"), (2, None), (None, "x y z")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    rows = [
        (None, "no id, a line of its own", "en", "s", 3), (None, None, None, None, None), (9001, None, "en", None, None), (9002, "", "en", "s", 0), (9003, "twice the very same row", "en", "s", 1), (9003, "twice the very same row", "en", "s", 1),
        (9003, "another text under the same id, long enough", "en", "s", 1), (9004, "tiny item of four", "en", "s", 1), (9005, "word " * 60_000, "en", "t", None), (9006, "word " * 60_000, "en", "t", None), (9007, "Twice the VERY same row\nrest of it", "de", "s", 2),
    ]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(f"own {c}") for c in ("score", "predicted", "kept_text", "n_lines", "n_dropped", "id", "h", "component_id", "kept", "others", "copy_no", "finish_time", "copies", "_drop", "term", "contaminated")}
    return held.select(more.columns).unionByName(more).withColumns(clash), str(tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, edges, name):
    docs, folder = edges
    step = dict(corpus_pipeline.STAGES)[name]
    out = step(spark, docs, folder)
    awkward = sorted((tuple(r) for r in out.where("doc_id > 9000 OR doc_id IS NULL").select("doc_id", "text").collect()), key=str)
    every = sorted(((r["doc_id"], r["text"]) for r in docs.where("doc_id > 9000 OR doc_id IS NULL").select("doc_id", "text").collect()), key=str)
    if name == "mixing":
        assert len(set(out.columns)) == len(out.columns) and set(docs.columns) <= set(out.columns)
        assert {r for r in awkward if r[0] != 9005} <= set(every)
    else:
        assert out.columns == docs.columns
        own = out.select("score", "kept_text", "others", "component_id", "copy_no").distinct().collect()
        assert [tuple(r) for r in own] == [("own score", "own kept_text", "own others", "own component_id", "own copy_no")]
    if name == "toxicity":
        assert [r for r in awkward if r[0] is None] == [r for r in every if r[0] is None]
        assert set(awkward) <= set(every)
    elif name == "line dedup":
        want = plain.deduped([(r[0], "\n".join(sorted(t or "" for d, t in every if d == r[0]))) for r in every if r[0] is not None])
        for d in (9001, 9002, 9003, 9004, 9006, 9007):
            assert sorted(x for t in [t for i, t in awkward if i == d] for x in t.split("\n")) == sorted({9003: [t for i, t in every if i == 9003]}.get(d, want[d][2].split("\n")))
    elif name == "near dedup":
        twice, once = (9003, "twice the very same row"), (9006, "word " * 60_000)
        lost = [once] + [r for r in every if r == twice][:1]
        assert awkward == sorted([r for r in every if r not in lost] + [twice], key=str)
    elif name == "decontamination":
        assert awkward == [r for r in every if r[0] != 9004]
    assert step(spark, docs.limit(0), folder).count() == 0


def test_reruns_agree(spark, edges):
    docs, folder = edges
    for name in ("line dedup", "near dedup", "decontamination", "mixing"):
        step = dict(corpus_pipeline.STAGES)[name]
        runs = [sorted(map(str, step(spark, d, folder).collect())) for d in (docs, docs.repartition(3, "text"))]
        assert runs[0] == runs[1]
