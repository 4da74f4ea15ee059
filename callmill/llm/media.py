"""Interleaved document sequences with media columns.

HTML becomes an ordered sequence of segments, each either text or a reference
to media by digest, with its caption (that of the innermost figure that has
one, else the alternative text).  A caption that no medium takes, as that of a
table or one outside a figure, is text at its place.  Media are stored once per task and digest in a table of their own, as
lossless 8-bit greyscale PNG images of ``WIDTH`` columns.  References are
joined to media by digest; positions and captions stay with the reference, so
they remain aligned whatever the join's order.

The payload of a text is its UTF-8 bytes and zero bytes up to the next
positive multiple of ``WIDTH``.  Payloads are never shuffled: images are
written where they are made, read back where they are decoded, and only their
digests and features are joined, by a sort-merge join that Spark can split
where a third of all documents refer to one image.

Null texts have the payload of an empty one; null HTML has no segments.  Any
text can be parsed: a declaration that HTML does not know is a comment up to
the next ``>``, an element of ``HIDDEN_TAGS`` that is never closed hides the
rest of the page, and a caption that neither it nor its figure closes is text
at its place.
References whose digest is not in the table keep null features.  Repeated rows
give repeated references.  Empty tables give empty results.  Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage, with_python_columns

WIDTH = 64
MEDIA_TAGS = {"img", "audio", "video", "source", "embed"}
HIDDEN_TAGS = {"script", "style", "template", "noscript"}
#: Tags that separate words in a caption.
BLOCK_TAGS = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "td", "th", "section", "article", "figure", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
SEGMENT = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType()),
])
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Sequence(HTMLParser):
    """Collects text and media segments in document order.

    A caption's pieces are segments at their places until its figure ends.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[dict] = []
        self.hidden = 0
        self.figures: list[dict[str, list]] = []  # of each open figure its captions, and the media that still have none
        self.caption: list[dict] | None = None  # the pieces of the open caption
        self.caption_of: dict[str, list] | None = None

    def parse_marked_section(self, i, report=1):
        """``<![...``: the parser's own version raises on most of these."""
        return self.parse_bogus_comment(i, report)

    def close(self):
        super().close()
        self._as_text(self.caption or [])  # never closed
        self.caption = None
        while self.figures:
            self._end_figure(closed=False)

    @staticmethod
    def _as_text(pieces: list[dict]) -> None:
        for s in pieces:
            s["kind"] = "text"

    def _end_caption(self) -> None:
        if self.caption is not None and self.caption_of is None:
            self._as_text(self.caption)
        elif self.caption is not None:
            self.caption_of["captions"].append(self.caption)
        self.caption = None

    def _end_figure(self, closed: bool = True) -> None:
        """The figure's last caption goes to those of its media that have none of an inner figure; other captions are text.

        In a figure that is never closed it goes to the media before it.
        """
        figure = self.figures.pop()
        if self.caption is not None and self.caption_of is figure:
            self._end_caption()
        told = [c for c in figure["captions"] if any(s["text"].strip() for s in c)]
        left = figure["media"]
        if told:
            own, end = told.pop(), len(self.segments)
            if not closed:
                end = own[0]["at"]
            text = " ".join(" ".join(s["text"] for s in own).split())
            taken, left = [s for s in left if s["at"] < end], [s for s in left if s["at"] >= end]
            for s in taken:
                s["caption"] = text
            if not taken:
                told.append(own)
        for other in told:
            self._as_text(other)
        if self.figures:  # the shorter list goes into the longer one
            short, long = sorted((left, self.figures[-1]["media"]), key=len)
            long += short
            self.figures[-1]["media"] = long

    def _add(self, segment: dict) -> dict:
        self.segments.append(segment | {"at": len(self.segments)})
        return self.segments[-1]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self._space()
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag == "figure":
            self.figures.append({"captions": [], "media": []})
        elif tag == "figcaption":
            self._end_caption()
            self.caption, self.caption_of = [], self.figures[-1] if self.figures else None
        elif tag in MEDIA_TAGS:
            found = dict(attrs)
            place = found.get("src") or next(iter((found.get("srcset") or "").split()), "").rstrip(",")
            if place:
                digest = place.removeprefix("sha256:") if place.startswith("sha256:") else None
                medium = self._add({"kind": "media", "text": place, "digest": digest, "caption": found.get("alt") or None})
                if self.figures:
                    self.figures[-1]["media"].append(medium)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._space()
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure" and self.figures:
            self._end_figure()

    def _space(self) -> None:
        if self.caption:
            self.caption[-1]["text"] += " "

    def handle_data(self, data):
        if self.hidden:
            return
        if self.caption and self.caption[-1] is self.segments[-1]:
            self.caption[-1]["text"] += data
        elif self.caption is not None:
            self.caption.append(self._add({"kind": "caption", "text": data}))
        elif data.strip():
            self._add({"kind": "text", "text": data})


def parse_sequence(html: str | None) -> list[dict]:
    """Segments in order, each with its position; texts that meet are one."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    kept: list[dict] = []
    texts: list[str] = []
    for s in [*parser.segments, None]:
        if s is not None and s["kind"] != "media":
            texts += s["text"].split() if s["kind"] == "text" else []
            continue
        if texts:
            kept.append({"kind": "text", "text": " ".join(texts), "digest": None, "caption": None})
            texts = []
        if s is not None:
            kept.append({k: s[k] for k in ("kind", "text", "digest", "caption")})
    return [{"pos": i, **s} for i, s in enumerate(kept)]


def with_sequences(docs: DataFrame, html: str = "html", sequence: str = "sequence") -> DataFrame:
    """``docs`` with the segments of its HTML."""
    return with_python_columns(docs, [html], lambda pages: [[parse_sequence(p) for p in pages]], [(sequence, T.ArrayType(SEGMENT))])


def resolve(docs: DataFrame, media: DataFrame, keys: list[str], sequence: str = "sequence") -> DataFrame:
    """A row per media reference: ``keys``, pos, caption, digest and the columns of ``media`` (a row per digest)."""
    refs = docs.select(*keys, F.explode(F.filter(sequence, lambda s: s["kind"] == "media")).alias("_ref"))
    refs = refs.select(*keys, *(F.col(f"_ref.{c}").alias(c) for c in ("pos", "caption", "digest")))
    return refs.join(media.hint("merge"), "digest", "left")


# ---- payloads as images

def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def payload_digest(text: Column) -> Column:
    """SHA-256 of the payload."""
    data = F.coalesce(text.cast("binary"), F.lit(b""))
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(data) / WIDTH) * WIDTH).cast("int")
    return F.sha2(F.rpad(data, size, F.lit(b"\0")), 256)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes, level: int = 1) -> bytes:
    """Bytes, a positive multiple of ``WIDTH``, as an 8-bit greyscale image."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    plain = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()  # filter 0 before each row
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain, level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; its checksums are verified."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG image")
    at, size, packed = 8, None, []
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are expected")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Height, mean, deviation, and which columns are brighter than the image (64 bits)."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    mean = float(rows.mean())
    bits = np.packbits(rows.mean(0) > mean).tobytes().hex()
    return f"{WIDTH}x{len(rows)};mean={mean:.4f};std={float(rows.std()):.4f};columns={bits}"


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """The written table of media (digest, media), made from texts; a batch writes a digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = {hashlib.sha256(p).hexdigest(): p for p in map(payload, batch.column(0).to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(map(to_png, held.values()), pa.binary())], names=["digest", "media"])

    return stage(docs.select(text).mapInArrow(run, "digest string, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """A row per digest, from the stored images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = from_png(image)
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(data)))
            names = [c.split()[0] for c in FEATURES.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            kinds = [pa.int64() if "long" in c else pa.string() for c in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select("digest", "media").mapInArrow(run, FEATURES).dropDuplicates(["digest"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as the one figure of an interleaved document, resolved: id, n_bytes, pos, caption and the image's features."""
    # written, so that the join reads both of its sides from exchanges of its own, which Spark can split
    features = stage(media_features(store_media(docs, text)), "features")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    html = F.concat(F.lit('<figure><img src="sha256:'), payload_digest(F.col(text)), F.lit('"><figcaption>'), n_bytes.cast("string"), F.lit(" bytes</figcaption></figure>"))
    pages = with_sequences(docs.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), html.alias("html")))
    return resolve(pages, features, ["id", "n_bytes"]).withColumnRenamed("id", id_col)
