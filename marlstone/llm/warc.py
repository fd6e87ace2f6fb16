"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about one size; each frame is compressed by itself, and a seek table in a skippable
frame at the end of the file gives every frame's compressed and uncompressed size. The index maps a record's identifier to
its file, frame and offset within the frame, so one record costs one small read and the decompression of one frame.

Each task writes its own files in the shared folder, under names that no other attempt uses, and returns index rows; the
index is written as a table before anything is read. So files of lost or repeated attempts are never referred to, and a
file that is referred to is complete.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import HOT_ROWS, join_stats, materialise, scratch_path

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FRAME, FILE = 1 << 19, 1 << 30
#: Payloads from this size are kept once.
LEAST_SHARED = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class SeekableWriter:
    """Independent frames and, on close, the seek table that ends the file."""

    def __init__(self, out: BinaryIO, level: int = 3):
        self.out, self.level, self.sizes, self.written = out, level, [], 0

    def frame(self, data: bytes) -> int:
        """Write one frame; its number."""
        packed = zstandard.ZstdCompressor(level=self.level).compress(data)
        self.out.write(packed)
        self.written += len(packed)
        self.sizes.append((len(packed), len(data)))
        return len(self.sizes) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class SeekableReader:
    """Frames of a bundle by number; only the seek table is read at first."""

    def __init__(self, source: BinaryIO):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - 9 - count * entry)
        table = source.read(count * entry)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=max(plain, 1))
        if len(data) != plain:
            raise ValueError("frame is damaged")
        return data


class Record(NamedTuple):
    record_id: str
    type: str
    page_id: int | None
    url: str | None
    payload: bytes | None
    payload_bytes: int
    digest: str
    refers_to: int | None
    refers_to_id: str | None


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}')}"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without it where refers_to is given."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}" if url else f"WARC-Target-URI: urn:page:{page_id}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(data: bytes) -> Record:
    """The record that these bytes are; a response's digest and length are those of the payload found, a revisit's those that it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    given = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(given["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(given["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    whole = given["WARC-Type"] == "response"
    if whole and hashlib.sha1(payload).hexdigest() != stated:
        raise ValueError("payload doesn't match its digest")
    length = len(payload) if whole else int(re.search(rb"Content-Length: (\d+)", http)[1])
    page, refers = given.get("Page-ID"), given.get("Refers-To-Page-ID")
    return Record(given["WARC-Record-ID"].strip("<>"), given["WARC-Type"], int(page) if page else None, given["WARC-Target-URI"], payload if whole else None, length, stated, int(refers) if refers else None, given["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in given else None)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


@lru_cache(8)
def _reader(path: str) -> SeekableReader:
    system, inside = _open(path)
    return SeekableReader(system.open_input_file(inside))


def fetch(path: str, frame: int, at: int, length: int) -> Record:
    """One record by its place in the index."""
    return decode(_reader(path).frame(frame)[at : at + length])


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_SHARED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload, of at least `least` bytes, is that of a page with a larger id. No payload is shuffled."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    keys = pages.select(F.col(id_col).cast("long").alias("page_id"), html.alias("html")).filter(F.octet_length("html") >= least).select("page_id", F.sha1("html").alias("digest"))
    last = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    return join_stats(keys, last, "digest", "n", "inner", hot_rows).filter("page_id < refers_to").distinct()


INDEX = "file string, frame int, records array<struct<record_id:string,page_id:bigint,at:bigint,length:bigint>>"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED, frame_bytes: int = FRAME, file_bytes: int = FILE, level: int = 3, date: str = "1970-01-01T00:00:00Z", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Write a record for each row of pages and return the index: a row for each frame with its records' identifiers, offsets and lengths.

    A null html has an empty payload, a null url a urn in its place. A row without a page_id is always a response, and so is every
    row that has the largest page_id of its payload. Rows that repeat have a record each, under one identifier. A record is
    never split, so a very long page is a frame of its own. Other columns are not read. An empty table writes nothing.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    marked = source.join(revisits(pages, id_col, html_col, least, hot_rows), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = _open(folder)
        system.create_dir(inside, recursive=True)
        context = TaskContext.get()
        names: dict[str, list] = {"file": [], "frame": [], "records": []}
        out: SeekableWriter | None = None
        name = ""
        parts: list[bytes] = []
        places: list[dict] = []
        size = 0

        def close_frame() -> None:
            nonlocal size
            if parts:
                names["file"].append(f"{folder}/{name}")
                names["frame"].append(out.frame(b"".join(parts)))
                names["records"].append(list(places))
                parts.clear()
                places.clear()
                size = 0

        def rows() -> pa.RecordBatch:
            kinds = {"file": pa.string(), "frame": pa.int32(), "records": pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]))}
            batch = pa.RecordBatch.from_arrays([pa.array(names[c], t) for c, t in kinds.items()], names=list(kinds))
            for c in names.values():
                c.clear()
            return batch

        for batch in batches:
            for page, url, text, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"pages-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    out = SeekableWriter(system.open_output_stream(f"{inside}/{name}", compression=None), level)
                data = encode(page, url, text.encode(), digest, refers, date)
                if parts and size + len(data) > frame_bytes:
                    close_frame()
                places.append({"record_id": record_id(page, digest), "page_id": page, "at": size, "length": len(data)})
                parts.append(data)
                size += len(data)
                if out.written > file_bytes:
                    close_frame()
                    out.close()
                    out = None
                    yield rows()
        if out is not None:
            close_frame()
            out.close()
        if names["file"]:
            yield rows()

    return materialise(marked.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Every record of the index, read from its frame by its offset: page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, frame, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _reader(path).frame(frame)
                out += [decode(data[x["at"] : x["at"] + x["length"]]) for x in records]
            cols = {"page_id": [r.page_id for r in out], "url": [r.url for r in out], "record_id": [r.record_id for r in out], "record_type": [r.type for r in out], "payload_bytes": [r.payload_bytes for r in out], "payload_digest": [r.digest for r in out], "refers_to": [r.refers_to for r in out]}
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c in ("page_id", "payload_bytes", "refers_to") else pa.string()) for c, v in cols.items()], names=list(cols))

    return index.select("file", "frame", "records").repartition("file", "frame").mapInArrow(run, "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def op1_warc(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, then read all of them back through the index."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN l USING (payload_digest)
"""
