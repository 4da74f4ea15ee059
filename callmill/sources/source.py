"""The store, and a sink that acknowledges, as data sources.

``register`` makes two formats known:

* ``callmill_store`` reads a store, at once or as a stream.  Conditions on day
  and request_id are answered by the reader: days choose folders, ids choose
  files and row groups.  A schema with fewer columns reads no others.
* ``callmill_parts`` takes a stream.  Tasks write files that nothing names yet;
  a micro-batch's commit names them in one acknowledgement, under its number,
  and its abort deletes them.  A micro-batch that is repeated finds its
  acknowledgement and leaves no second copy.  ``acknowledged`` reads what is
  named, so each row is there once.

A stream's offset is the version whose writes it has read.  A row belongs to
the version that brought it, also after it was moved to another file, so it is
read once; a row that was written again, or came back from the quarantine, is a
new one.  What was delivered or withdrawn before the stream reached it is not
read.  The option ``bytes_per_batch`` bounds a micro-batch by the bytes of the
folders to read, by whole versions and at least one; with it goes the option
``reader``, a name for the stream, under which its place is noted so that a
restarted stream knows it.

Readers have no session, so folders are opened with pyarrow's file systems.  A
read that a sweep overtakes fails for want of its file, and is made again from
the version that is there then.  An empty or missing store gives no rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .spool import RECORDS

STORE, PARTS = "callmill_store", "callmill_parts"
#: Rows that a task holds at once, and the bytes of small files that it reads: packed ones, of which few hold many rows.
ROWS_AT_ONCE, BYTES_A_TASK = 4096, 4 << 20
PARQUET = ds.ParquetFileFormat(read_options=ds.ParquetReadOptions(coerce_int96_timestamp_unit="us"))


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let it push conditions to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
    spark.dataSource.register(PartsSink)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _sizes(fs: pafs.FileSystem, folder: str) -> dict[str, int]:
    """The bytes of each file, by name."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and not f.base_name.startswith(("_", "."))}


def _names(fs: pafs.FileSystem, folder: str) -> list[str]:
    return list(_sizes(fs, folder))


def _latest(fs: pafs.FileSystem, root: str) -> tuple[int, dict]:
    """The latest version's number and what it says."""
    while names := [n for n in _names(fs, f"{root}/versions") if re.fullmatch(r"\d{12}\.json", n)]:
        try:
            with fs.open_input_file(f"{root}/versions/{names[-1]}") as f:
                return int(names[-1][:-5]), json.loads(f.read())
        except FileNotFoundError:  # swept meanwhile: a later one is there
            continue
    return 0, {"days": {}, "gens": {}, "gone": {}, "withdrawn": []}


# ---- conditions

_TESTS = {
    api.EqualTo: lambda c, v: c == v, api.EqualNullSafe: lambda c, v: c == v, api.GreaterThan: lambda c, v: c > v, api.GreaterThanOrEqual: lambda c, v: c >= v,
    api.LessThan: lambda c, v: c < v, api.LessThanOrEqual: lambda c, v: c <= v, api.In: lambda c, v: c.isin(list(v)),
}


def _answers(condition: api.Filter) -> bool:
    """Whether the reader answers a condition: one on day or request_id, which are never null, with texts."""
    if type(condition) not in _TESTS or condition.attribute not in (("day",), ("request_id",)):
        return False
    values = condition.value if isinstance(condition, api.In) else [condition.value]
    return all(isinstance(v, str) for v in values)


def _all_of(conditions: Iterable[tuple[type, str, object]]) -> ds.Expression | None:
    found = None
    for kind, column, value in conditions:
        test = _TESTS[kind](ds.field(column), value)
        found = test if found is None else found & test
    return found


def _holds(conditions: list[tuple[type, str, object]], day: str) -> bool:
    """Whether a day passes the conditions on days."""
    test = _all_of(c for c in conditions if c[1] == "day")
    return test is None or pa.table({"day": [day]}).filter(test).num_rows > 0


# ---- reading

@dataclass
class Part:
    """A file of a day, and which of its rows are not to be read."""

    file: str
    size: int
    day: str
    conditions: list  # (kind, column, value)
    gone: list  # ranges (after, last, gens that came later)
    withdrawn: list  # tables of single rows
    gens: list | None  # the writes to read, if not all


@dataclass
class Task(api.InputPartition):
    """Files that one task reads."""

    parts: list[Part]


def _tasks(parts: list[Part]) -> list[Task]:
    """A task for each large file, or for as many small ones as make one."""
    tasks, size = [Task([])], 0
    for part in parts:
        if tasks[-1].parts and size + part.size > BYTES_A_TASK:
            tasks.append(Task([]))
            size = 0
        tasks[-1].parts.append(part)
        size += part.size
    return tasks


def _parts(fs: pafs.FileSystem, root: str, m: dict, conditions: list, gens: set[str] | None = None) -> list[Part]:
    found = []
    for day in sorted(d for d in m["days"] if _holds(conditions, d)):
        gone = [(after, last, sorted(g for g, v in m["gens"].items() if v > version)) for after, last, version in m["gone"].get(day, [])]
        withdrawn = [f"{root}/{t['at']}" for t in m["withdrawn"] if day in t["days"]]
        for folder in m["days"][day]:
            if gens is not None and not gens & set(folder["gens"]):
                continue
            wanted = None if gens is None else sorted(gens & set(folder["gens"]))
            found += [Part(f"{root}/{folder['at']}/{name}", size, day, conditions, gone, withdrawn, wanted) for name, size in _sizes(fs, f"{root}/{folder['at']}").items()]
    return found


def _withdrawn(fs: pafs.FileSystem, part: Part) -> set[tuple[str, str]]:
    """Ids and writes of single rows that are gone, of those that the file can hold."""
    if not part.withdrawn:
        return set()
    ids = ds.field("request_id")
    with fs.open_input_file(part.file) as f:
        meta = pq.read_metadata(f)
    column = meta.schema.to_arrow_schema().names.index("request_id")
    bounds = [meta.row_group(i).column(column).statistics for i in range(meta.num_row_groups)]
    test = ds.field("day") == part.day
    if bounds and all(b is not None and b.has_min_max for b in bounds):
        test = test & (ids >= min(b.min for b in bounds)) & (ids <= max(b.max for b in bounds))
    found: set[tuple[str, str]] = set()
    for folder in part.withdrawn:
        table = ds.dataset([f"{folder}/{n}" for n in _names(fs, folder)], filesystem=fs, format="parquet").to_table(["request_id", "gen"], filter=test)
        found.update(zip(table["request_id"].to_pylist(), table["gen"].to_pylist(), strict=True))
    return found


def _read(fs: pafs.FileSystem, part: Part, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    test = _all_of(part.conditions)
    for after, last, later in part.gone:
        inside = (ds.field("request_id") > after) & (ds.field("request_id") <= last)
        inside = inside & ~ds.field("gen").isin(later) if later else inside
        test = ~inside if test is None else test & ~inside
    if part.gens is not None:
        own = ds.field("gen").isin(part.gens)
        test = own if test is None else test & own
    lost = _withdrawn(fs, part)
    columns = list(dict.fromkeys([*schema.names, "request_id", "gen"])) if lost else schema.names
    for batch in ds.dataset(part.file, filesystem=fs, format=PARQUET).to_batches(columns=columns, filter=test, batch_size=ROWS_AT_ONCE):
        if lost:
            keys = zip(batch["request_id"].to_pylist(), batch["gen"].to_pylist(), strict=True)
            batch = batch.filter(pa.array([k not in lost for k in keys], pa.bool_()))
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch[f.name].cast(f.type) for f in schema], schema=schema)


def _read_all(path: str, task: Task, columns: StructType) -> Iterator[pa.RecordBatch]:
    fs, _ = _open(path)
    for part in task.parts:
        yield from _read(fs, part, to_arrow_schema(columns))


class StoreSource(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return STORE

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> api.DataSourceReader:
        return StoreReader(self.options, schema)

    def streamReader(self, schema: StructType) -> api.DataSourceStreamReader:
        return StoreStream(self.options, schema)


class StoreReader(api.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns, self.conditions = options["path"], schema, []

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        for condition in filters:
            if _answers(condition):
                self.conditions.append((type(condition), condition.attribute[0], condition.value))
            else:
                yield condition

    def partitions(self) -> list[Task]:
        fs, root = _open(self.path)
        return _tasks(_parts(fs, root, _latest(fs, root)[1], self.conditions))

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        yield from _read_all(self.path, partition, self.columns)


class StoreStream(api.DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema
        self.most, self.reader = int(options.get("bytes_per_batch", 0)), options.get("reader", "")
        self.at: int | None = None
        if self.most and not re.fullmatch(r"[\w-]+", self.reader):
            raise ValueError("bytes_per_batch needs a reader: a name of letters, digits, _ and -")

    def _place(self) -> tuple[pafs.FileSystem, str]:
        fs, root = _open(self.path)
        return fs, f"{root}/readers/{self.reader}.json"

    def _noted(self) -> int:
        fs, at = self._place()
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            return 0
        with fs.open_input_file(at) as f:
            return json.loads(f.read())["version"]

    def initialOffset(self) -> dict:
        self.at = 0
        return {"version": 0}

    def latestOffset(self) -> dict:
        """The last version that brought rows which are still there, or as many versions as a micro-batch may take."""
        fs, root = _open(self.path)
        m = _latest(fs, root)[1]
        if not self.most:
            self.at = max([self.at or 0, *m["gens"].values()])
            return {"version": self.at}
        at, taken, size = self._noted() if self.at is None else self.at, set(), 0
        folders = [f for day in m["days"].values() for f in day]
        for version in sorted(v for v in set(m["gens"].values()) if v > at):
            own = {g for g, v in m["gens"].items() if v == version}
            new = [f for f in folders if f["at"] not in taken and own & set(f["gens"])]
            size += sum(f["bytes"] for f in new)
            if taken and size > self.most:
                break
            taken |= {f["at"] for f in new}
            at = version
        self.at = at
        return {"version": at}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        if self.most:
            if end["version"] < start["version"]:
                raise ValueError(f"two streams are named {self.reader}")
            fs, at = self._place()
            fs.create_dir(at.rpartition("/")[0])
            with fs.open_output_stream(at) as f:
                f.write(json.dumps(end).encode())
        self.at = max(self.at or 0, end["version"])
        fs, root = _open(self.path)
        m = _latest(fs, root)[1]
        return _tasks(_parts(fs, root, m, [], {g for g, v in m["gens"].items() if start["version"] < v <= end["version"]}))

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        yield from _read_all(self.path, partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


# ---- the sink

@dataclass
class Written(api.WriterCommitMessage):
    """What one task wrote."""

    part: str
    rows: int


class PartsSink(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return PARTS

    def streamWriter(self, schema: StructType, overwrite: bool) -> api.DataSourceStreamWriter:
        return PartsWriter(self.options["path"], to_arrow_schema(schema))


class PartsWriter(api.DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        fs, root = _open(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    fs.create_dir(f"{root}/parts")
                    out = pq.ParquetWriter(f"{root}/parts/{name}", self.schema, filesystem=fs, compression="zstd")
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, self.schema, strict=True)], schema=self.schema))
                rows += batch.num_rows
        if out is None:
            return None
        out.close()
        return Written(name, rows)

    def _forget(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(f"{root}/parts/{m.part}").is_file:
                fs.delete_file(f"{root}/parts/{m.part}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        """The acknowledgement of a micro-batch, whole or absent; the first one counts."""
        fs, root = _open(self.path)
        at = f"{root}/acknowledged/{batchId:012d}.json"
        if fs.get_file_info(at).is_file:
            with fs.open_input_file(at) as f:
                named = {p["part"] for p in json.loads(f.read())["parts"]}
            return self._forget([m for m in messages if m is not None and m.part not in named])
        fs.create_dir(f"{root}/acknowledged")
        made = f"{root}/acknowledged/.{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"batch": batchId, "parts": [{"part": m.part, "rows": m.rows} for m in messages if m is not None]}).encode())
        fs.move(made, at)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._forget(messages)


def acknowledged(spark: SparkSession, path: str, schema: str = RECORDS, after: int = -1) -> DataFrame:
    """The rows of all micro-batches behind number ``after`` that are acknowledged."""
    fs, root = _open(path)
    parts = []
    for name in _names(fs, f"{root}/acknowledged"):
        if int(name[:-5]) > after:
            with fs.open_input_file(f"{root}/acknowledged/{name}") as f:
                parts += [p["part"] for p in json.loads(f.read())["parts"]]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/parts/{p}" for p in parts))
