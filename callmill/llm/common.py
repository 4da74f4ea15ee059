"""Helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names.  Where that is unset, a local
    master gets a temporary folder; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="callmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Paths that the open ``temporary`` blocks will remove, the innermost last.
_TEMPORARY: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("temporary", default=())


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end, so nothing that outlives the block may read it.

    What is to be kept is removed with the block around this one, if there is one.
    """
    token = _TEMPORARY.set((*_TEMPORARY.get(), []))
    try:
        yield
    finally:
        for path in _TEMPORARY.get()[-1]:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _TEMPORARY.reset(token)


def removed_with_block(path: str) -> None:
    """The innermost open ``temporary`` block, if there is one, removes ``path`` at its end."""
    if blocks := _TEMPORARY.get():
        blocks[-1].append(path)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that it ran, never
    what was written before.
    """
    path = f"{scratch_dir(df.sparkSession)}/callmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    blocks = _TEMPORARY.get()[:-1] if keep else _TEMPORARY.get()
    if blocks:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


#: Rows that a task holds as Python values at once.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_python_columns(df: DataFrame, inputs: list[str], make: Callable[..., list], added: list[tuple[str, T.DataType]], drop: tuple[str, ...] = (), rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with columns that ``make`` builds from the lists of its ``inputs``.

    ``make`` returns a list of values for each added column.  The other columns
    pass through as Arrow data, untouched.  Columns of ``df`` that have the
    name of an added one are replaced.
    """
    names = {n for n, _ in added} | set(drop)
    kept = [f for f in df.schema if f.name not in names]
    arrow = [(n, to_arrow_type(t)) for n, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            made = make(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs))
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(v, t) for v, (_, t) in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [n for n, _ in arrow])

    out = T.StructType([*kept, *(T.StructField(n, t) for n, t in added)])
    return df.mapInArrow(run, out)


#: Partitions whose sums one second-level group adds up.
FAN_IN = 64


def summed(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The matrix that rows of partial sums (part, row, v) add up to, always in the order of the partitions."""
    schema = "part long, row long, v array<double>"

    def add(table: pa.Table) -> pa.Table:
        table, total = table.sort_by("part"), np.zeros(columns)
        for v in table["v"].to_pylist():
            total += v
        return pa.table({"part": table["part"][:1], "row": table["row"][:1], "v": pa.array([total], pa.list_(pa.float64()))})

    sums = parts.groupBy("row", F.floor(F.col("part") / FAN_IN)).applyInArrow(lambda table: add(table), schema).groupBy("row").applyInArrow(lambda table: add(table), schema)
    out = np.zeros((rows, columns))
    for r in sums.collect():
        out[r["row"]] = r["v"]
    return out
