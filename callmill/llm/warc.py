"""WARC records in ZIP packages: a writer, and a reader that extracts nothing.

A package that is written here holds two stored (uncompressed) members:
``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, a line per record with its archive, offset and length.
The reader finds the end of central directory, or its ZIP64 form, parses the
central directory, locates all archives and indexes (plain or gzip-ed), and
then reads byte ranges: each index, and each record from the archive that its
line names.  Nothing is unpacked to disk.  A record that several indexes name
is read once; one that can't be read, or whose archive is missing, gives a row
with the reason in ``error`` and without the rest.

Packages are ZIP files in the shared folder, each under a name of its own; the
table of packages (path, size) commits with Spark's writer.  A task that is
lost or repeated leaves at most files that no table names.  A package is
closed at ``PACKAGE_BYTES`` of archive, which bounds a task's memory; one
longer record makes a package of its own.  Readers open a package where it
lies and read from it the directory, the indexes and one record at a time.
Inside a ``temporary`` block the packages are removed with it.

Of records whose payloads are equal (by SHA-256), the one with the largest id
is the response and the others are revisits that name it.  Digests, ids and
addresses are shuffled for this choice; payloads only of responses that have
revisits, and of the few that a bounded filter takes for such.  All others are
written where they are read, and revisits, which hold none, without payload.
Payloads shorter than ``min_bytes`` are all responses.  A null payload is
empty.  Ids are integers or strings.  Repeated rows with the largest id are
all responses.  Null ids are revisits of a record with an id, and responses
where there is none.  An empty table makes no package.  Only the id, url and
payload columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed_with_block, scratch_dir, slices, stage, temporary
from .line_dedup import with_mark

PACKAGE_BYTES = 4 << 20
#: Bytes of packages that one reading task gets about.
READ_BYTES = 16 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVES, INDEXES = "archive/", "indexes/"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, error string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing

def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, length: int | None = None) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit carries no payload, but its length."""
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload) if length is None else length)),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{quote(str(refers_to), safe='')}>")]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def pack(records: list[tuple[str, bytes]], force_zip64: bool = False) -> bytes:
    """A ZIP package of (index key, gzip member) records."""
    out, lines, at = io.BytesIO(), [], 0
    for key, data in records:
        lines.append(f"{key} {DATE} {json.dumps({'offset': at, 'length': len(data), 'filename': ARCHIVE.rpartition('/')[2]})}\n")
        at += len(data)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((ARCHIVE, (d for _, d in records)), (INDEX, (x.encode() for x in lines))):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=force_zip64) as member:
                for part in parts:
                    member.write(part)
    return out.getvalue()


def put_file(folder: str, data: bytes) -> str:
    """Write a file of a new name into a shared folder, under another name until it is whole; its URI."""
    store, path = fs.FileSystem.from_uri(folder)
    name = uuid.uuid4().hex
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/.{name}.part") as out:
        out.write(data)
    store.move(f"{path}/.{name}.part", f"{path}/{name}.zip")
    return f"{folder}/{name}.zip"


def _with_digest(pages: DataFrame, id_col: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), body.alias("payload")).withColumn("sha", F.sha2("payload", 256))


def records_to_write(rows: DataFrame, min_bytes: int) -> DataFrame:
    """id, url, payload (null for revisits), sha1, length and refers_to (null for responses) of every row."""
    facts = ("id", "url", "sha", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"))
    slim = stage(rows.select(*facts), "digests")
    # written, so that the joins read both of their sides from exchanges of their own, which Spark can split
    holders = stage(slim.where(F.col("length") >= min_bytes).groupBy("sha").agg(F.max("id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL").select("sha", "holder"), "holders")
    shared = with_mark(slim, "sha", holders.select(F.col("sha").alias("_drop_id"))).where("_drop_maybe").drop("_drop_maybe")
    judged = stage(shared.join(holders.hint("merge"), "sha", "left").withColumn("copy", F.coalesce(~F.col("id").eqNullSafe(F.col("holder")) & F.col("holder").isNotNull(), F.lit(False))), "judged")
    copies = judged.where("copy").select("id", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "length", F.col("holder").alias("refers_to"))
    # the rows that need their payload although others may have it: all that are no copies
    own = judged.where("NOT copy").select("sha", F.col("id").alias("own_id")).distinct()
    place = lambda i: F.concat_ws(":", "sha", F.coalesce(i.cast("string"), F.lit("")))
    marked = with_mark(rows, "sha", holders.select(F.col("sha").alias("_drop_id"))).withColumn("place", place(F.col("id")))
    alone = marked.where("NOT _drop_maybe")
    among = with_mark(marked.where("_drop_maybe").drop("_drop_maybe"), "place", own.select(place(F.col("own_id")).alias("_drop_id"))).where("_drop_maybe")
    named = own.withColumnRenamed("sha", "own_sha").hint("merge")
    among = among.join(named, (among["sha"] == named["own_sha"]) & among["id"].eqNullSafe(named["own_id"]), "left_semi")
    written = [df.select("id", "url", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"), F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to")) for df in (alone, among)]
    return written[0].unionByName(written[1]).unionByName(copies)


def write_packages(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """The table of packages (path, size), whose files are written to the shared folder."""
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark)}/callmill-packages-{uuid.uuid4().hex}"
    removed_with_block(folder)

    def made(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        data = pack(held)
        return pa.RecordBatch.from_arrays([pa.array([put_file(folder, data)], pa.string()), pa.array([len(data)], pa.int64())], names=["path", "size"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 64):
            for page_id, address, body, sha1, length, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = gzip.compress(warc_record(page_id, address, body or b"", digest, refers_to, length), compresslevel=1, mtime=0)
                held.append((f"urn:page:{'' if page_id is None else quote(str(page_id), safe='')}", data))
                size += len(data)
                if size >= PACKAGE_BYTES:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    with temporary(spark):
        return stage(records_to_write(_with_digest(pages, id_col, url, payload), min_bytes).mapInArrow(write, "path string, size long"), "packages", keep=True)


# ---- reading

ReadAt = Callable[[int, int], bytes]


def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """Replace the saturated ones of uncompressed size, compressed size and header offset by those of the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [values.pop(0) if w == 0xFFFFFFFF and values else w for w in wanted]
        at += 4 + n
    return wanted


def central_directory(read_at: ReadAt, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name → (offset of the local header, stored size, compression method, flags), from the package's last bytes."""
    tail = read_at(max(0, size - 65_557), min(size, 65_557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = tail.rfind(b"PK\x06\x07", 0, end)
        if locator < 0:
            raise ValueError("no ZIP64 locator")
        at64 = struct.unpack_from("<Q", tail, locator + 8)[0]
        record = read_at(at64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    data, at, members = read_at(start, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        full, packed, offset = _zip64(data[at + 46 + n_name : at + 46 + n_name + n_extra], [full, packed, offset])
        members[name] = (offset, packed, method, flags)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_range(read_at: ReadAt, member: tuple[int, int, int, int]) -> tuple[int, int]:
    """Where the bytes of a stored member begin, and how many there are."""
    offset, size, method, flags = member
    head = read_at(offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    if method != 0 or flags & 1:
        raise ValueError("member is compressed or encrypted; ranges need stored members")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra, size


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the HTTP payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def index_entries(read_at: ReadAt, members: dict[str, tuple[int, int, int, int]]) -> Iterator[tuple[str, dict]]:
    """Key and entry of every line of all indexes."""
    for name in sorted(m for m in members if m.startswith(INDEXES) and not m.endswith("/")):
        data = read_at(*stored_range(read_at, members[name]))
        for line in (gzip.decompress(data) if name.endswith(".gz") else data).decode("utf-8", "replace").splitlines():
            parts = line.split(" ", 2)
            if len(parts) == 3 and parts[2].startswith("{") and not line.startswith("!"):
                yield parts[0], json.loads(parts[2])


def package_records(read_at: ReadAt, size: int) -> Iterator[tuple[str, dict[str, str], bytes, str | None]]:
    """Index key, fields and payload of every indexed record, read by its range from the archive that its entry names; or the reason why not."""
    members = central_directory(read_at, size)
    archives = {name.removeprefix(ARCHIVES): name for name in members if name.startswith(ARCHIVES) and not name.endswith("/")}
    starts, seen = {}, set()
    for key, entry in index_entries(read_at, members):
        name = archives.get(entry.get("filename", "").removeprefix(ARCHIVES))
        place = (name, int(entry.get("offset", -1)), int(entry.get("length", -1)))
        if name is not None and place in seen:
            continue
        seen.add(place)
        try:
            if name is None:
                raise ValueError(f"no archive {entry.get('filename', '')}")
            if name not in starts:
                starts[name] = stored_range(read_at, members[name])
            start, most = starts[name]
            if place[1] < 0 or place[2] < 0 or place[1] + place[2] > most:
                raise ValueError("a range outside of its archive")
            data = read_at(start + place[1], place[2])
            yield key, *parse_record(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data), None
        except (ValueError, KeyError, OSError, EOFError, zlib.error) as e:
            yield key, {}, b"", str(e)


def read_packages(packages: DataFrame, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and error of every record.

    A response's length and digest come from the payload read back, a
    revisit's from its header fields.
    """
    whole = kind in ("tinyint", "smallint", "int", "integer", "bigint", "long")

    def page(urn: str | None):
        text = (urn or "").strip("<>").removeprefix("urn:page:")
        return (int(text) if whole else unquote(text)) if text else None

    def row(key: str, fields: dict[str, str], payload: bytes, error: str | None) -> tuple:
        if error is not None:
            return page(key), None, None, None, None, error
        length, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response":
            length, digest = len(payload), payload_digest(payload)
        return page(fields["warc-record-id"]), length, digest, fields["warc-type"], page(fields.get("warc-refers-to")), None

    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64() if whole else pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64() if whole else pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at_path = fs.FileSystem.from_uri(path)
                with store.open_input_file(at_path) as file:
                    rows = [row(*r) for r in package_records(lambda at, n, file=file: file.read_at(n, at), size)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    total = packages.agg(F.sum("size")).first()[0] or 0
    spread = packages.select("path", "size").repartition(max(1, -(-total // READ_BYTES)))
    return spread.mapInArrow(read, RECORDS.format(kind="long" if whole else kind))
