"""WARC records in seekable Zstandard bundles.

A bundle is one row of a table: `content` holds independent frames of whole records and
a skippable frame with the seek table, byte for byte a `.warc.zst` file that any
Zstandard reader expands and a seeking one opens at any frame. `entries` maps each
record to its frame and its place in the expanded frame. As a table, bundles go through
Spark's writer to wherever the shared folder lies and are committed per task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType,
)

from .common import map_batches, written

FRAME_BYTES = 1 << 20  # a frame ends with the record that reaches this size
BUNDLE_BYTES = 8 << 20  # a bundle ends with the frame that reaches this size, before compression
MIN_REVISIT_BYTES = 1000

# Fixed values of the seekable format: a skippable frame's magic number, the footer's.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

# Fixed values of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

ENTRY = StructType(
    [
        StructField("record_id", StringType()),
        StructField("frame", IntegerType()),
        StructField("offset", LongType()),
        StructField("length", LongType()),
    ]
)


def record_types(pages: DataFrame, id_column: str, html_column: str, least: int) -> DataFrame:
    """Every page's id, `payload_digest`, `payload_bytes`, `record_type` and `refers_to`.

    Of equal payloads of at least `least` bytes the largest id is the response. Only
    digests move: the maximum is combined before its shuffle, and AQE splits the join
    where a third of all pages are one payload. A page without id is a response; pages
    that repeat the response's id are responses too.
    """
    payload = F.coalesce(F.encode(F.col(html_column), "UTF-8"), F.lit(b""))
    digests = pages.select(
        F.col(id_column).alias("id"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    digests = written(digests, "warc_digests")
    long = digests.where(F.col("payload_bytes") >= least)
    latest = long.groupBy("payload_digest", "payload_bytes").agg(F.max("id").alias("latest"), F.count(F.lit(1)).alias("n"))
    latest = latest.where("n > 1").drop("n")
    joined = digests.join(latest, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("latest") != F.col("id"), F.col("latest"))
    return joined.select(
        "id", "payload_digest", "payload_bytes",
        F.when(refers.isNotNull(), "revisit").otherwise("response").alias("record_type"),
        refers.alias("refers_to"),
    )


def record_id(page_id) -> str:
    """The record's URN, made from the page's id alone so that a repeated task writes the same."""
    raw = hashlib.md5(f"page {page_id}".encode(), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{raw[:8]}-{raw[8:12]}-{raw[12:16]}-{raw[16:20]}-{raw[20:]}>"


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; the page's id travels in an extension header."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    target = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "")
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        headers.append(f"X-Page-ID: {page_id}")
    if revisit:
        headers += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, expanded) bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_bounds(content: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(start, compressed, expanded) bytes of every frame, from the footer alone."""
    count, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    bounds, start = [], 0
    for compressed, expanded in struct.iter_unpack("<II", content[-9 - 8 * count : -9]):
        bounds.append((start, compressed, expanded))
        start += compressed
    return bounds


def read_record(content: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record of a bundle; only its frame is expanded."""
    start, compressed, expanded = frame_bounds(content)[frame]
    data = zstandard.ZstdDecompressor().decompress(content[start : start + compressed], max_output_size=expanded)
    return data[offset : offset + length]


class _Bundle:
    def __init__(self):
        self.squeeze = zstandard.ZstdCompressor(level=3)
        self.parts: list[bytes] = []
        self.frames: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, name: str, record: bytes) -> None:
        self.entries.append({"record_id": name, "frame": len(self.frames), "offset": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            frame = self.squeeze.compress(b"".join(self.open))
            self.parts.append(frame)
            self.frames.append((len(frame), self.open_bytes))
            self.bytes += self.open_bytes
            self.open, self.open_bytes = [], 0

    def row(self) -> tuple[bytes, list[dict]]:
        self.end_frame()
        return b"".join([*self.parts, seek_table(self.frames)]), self.entries


def write_bundles(
    pages: DataFrame,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """The pages as a written table of bundles: `content` and `entries`.

    A null html is an empty payload, a null url an empty target, a null id leaves the
    page's header out. Rows that repeat an id give a record each under the same name.
    Payloads pass one shuffle, by id; a task holds one bundle at a time.
    """
    kinds = record_types(pages, id_column, html_column, least).dropDuplicates(["id", "payload_digest"])
    payload = F.coalesce(F.encode(F.col(html_column), "UTF-8"), F.lit(b""))
    source = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), payload.alias("payload"),
                          F.sha1(payload).alias("digest"))
    kinds = kinds.select(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to")
    on = source["id"].eqNullSafe(kinds["_id"]) & (source["digest"] == kinds["_digest"])
    rows = source.join(kinds, on, "left").select("id", "url", "payload", "digest", "refers_to")
    schema = StructType([StructField("content", BinaryType()), StructField("entries", ArrayType(ENTRY))])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["content", "entries"]
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))

        def batch_of(b: _Bundle) -> pa.RecordBatch:
            content, entries = b.row()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary()), pa.array([entries], kind)], names=names)

        current = _Bundle()
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for page, url, payload, digest, refers in zip(*columns, strict=True):
                page, refers = page.as_py(), refers.as_py()
                current.add(record_id(page), _record(page, url.as_py(), payload.as_py(), digest.as_py(), refers))
                if current.bytes >= BUNDLE_BYTES:
                    yield batch_of(current)
                    current = _Bundle()
        if current.entries:
            yield batch_of(current)

    return written(map_batches(rows, bundle, schema), "warc_bundles")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an expanded frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_bundles(bundles: DataFrame, id_type) -> DataFrame:
    """The records of the bundles: page id, type, payload size and digest, what a revisit refers to.

    Each record is found through its entry: the frame is expanded by the seek table, the
    record cut out at its offset and length, and its identifier must be the entry's.
    Entries that do not make up their frame fail the job.
    Size and digest of a response are taken from its payload, and the digest must be
    the header's; a revisit carries those of the response it stands for in its headers.
    """
    schema = StructType(
        [
            StructField("record_id", StringType()),
            StructField("page_id", StringType()),
            StructField("payload_bytes", LongType()),
            StructField("payload_digest", StringType()),
            StructField("record_type", StringType()),
            StructField("refers_to", StringType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for content, entries in zip(batch.column("content"), batch.column("entries"), strict=True):
                view, named = memoryview(content.as_buffer()), entries.values
                names, frame, offset, length = (named.field(c).to_pylist() for c in ("record_id", "frame", "offset", "length"))
                at = 0
                for number, (start, compressed, expanded) in enumerate(frame_bounds(view)):
                    rows, begin = [], at
                    data = expand.decompress(view[start : start + compressed], max_output_size=expanded)
                    while at < len(names) and frame[at] == number:
                        record = data[offset[at] : offset[at] + length[at]]
                        ((headers, block),) = parse_records(record)
                        if headers["WARC-Record-ID"] != names[at]:
                            raise ValueError(f"the entry of {names[at]} leads to {headers['WARC-Record-ID']}")
                        at += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        if kind == "response" and hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest:
                            raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                        size = len(payload) if kind == "response" else int(http.rpartition(b": ")[2])
                        rows.append((headers["WARC-Record-ID"], headers.get("X-Page-ID"), size, digest, kind, headers.get("X-Refers-To-Page-ID")))
                    if sum(length[begin:at]) != expanded:
                        raise ValueError("the entries do not make up their frame")
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    records = map_batches(bundles.select("content", "entries"), read, schema)
    return records.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def index(bundles: DataFrame) -> DataFrame:
    """Where each record lies: `bundle` (its first record's id), `record_id`, `frame`, `offset`, `length`."""
    return bundles.select(F.element_at("entries", 1)["record_id"].alias("bundle"), F.inline("entries"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Every page as its record says after writing and reading the bundles; empty for no pages."""
    bundles = write_bundles(pages, **options)
    id_type = pages.schema[options.get("id_column", "page_id")].dataType
    return read_bundles(bundles, id_type).drop("record_id")
