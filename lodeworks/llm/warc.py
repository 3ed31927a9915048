"""WARC archives of web pages: written with an index, read back by coalesced byte ranges.

Writing is index first: each task writes archive files of its own (one gzip member a record)
and returns one index row per record: file, offset, length, URL and digest. Files of lost
attempts are never in the index. Reading sorts the index by file and offset, joins
neighbouring ranges into one read, and cuts the bytes into records again.

Of pages with equal payloads, the one with the largest page_id is a response; the others are
revisit records, which hold its HTTP head but not the payload. Files are reached through
Arrow's file systems by the URI of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.words import slices
from lodeworks.session import fresh_path, stage_table

#: Smallest payload that a revisit stands for.
MIN_REVISIT_BYTES = 0
#: Bytes after which a task opens its next archive file.
FILE_BYTES = 1 << 28
#: Longest read, and longest gap of unwanted bytes that one read spans.
READ_BYTES, GAP_BYTES = 1 << 22, 1 << 16
INDEX_SCHEMA = (
    "path string, offset long, length long, page_id long, url string, payload_digest string, "
    "record_type string"
)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, revisit=False) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    target = " ".join((url or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {name: value.strip() for name, value in pairs}


def parse_record(raw: bytes) -> Record:
    """A record from its uncompressed bytes; refuses a block of the wrong length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _fields(head)
    block = rest[: int(headers["Content-Length"])]
    if not head.startswith(b"WARC/1.") or len(block) != int(headers["Content-Length"]):
        raise ValueError("broken WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _fields(http), payload)


class _Writer:
    """Archive files of one task attempt."""

    def __init__(self, folder: str, file_bytes: int):
        self._fs, self._folder = pafs.FileSystem.from_uri(folder)
        self._uri, self._limit, self._file, self.path, self.at = folder, file_bytes, None, "", 0

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self._file is None or self.at >= self._limit:
            self.close()
            name = f"{uuid.uuid4().hex}.warc.gz"
            self._file = self._fs.open_output_stream(f"{self._folder}/{name}", compression=None)
            self.path, self.at = f"{self._uri}/{name}", 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self._file.write(packed)
        self.at += len(packed)
        return self.path, self.at - len(packed), len(packed)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None


def _folder(spark) -> str:
    """A new archive folder in the shared folder, as a URI, already there."""
    path = fresh_path(spark, "warc")
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    fs, local = pafs.FileSystem.from_uri(uri)
    fs.create_dir(local, recursive=True)
    return uri


def write_archives(
    pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in the shared folder; returns the staged index.

    A null html is an empty payload and a null url an empty target. Pages without an id are
    responses of their own. Of repeated rows with one id and payload, one is the response and
    the others revisit it. Other columns are not looked at.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").alias("n"))
    keyed = keyed.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull())
    # one row a payload, from sums of each task; only payloads that occur again are joined
    again = keyed.groupBy("sha1").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    targets = keyed.select("page_id", "sha1").distinct().join(again, "sha1").select(
        "page_id", "sha1", "refers_to")
    marked = pages.withColumn("sha1", F.sha1("html")).join(targets, ["page_id", "sha1"], "left")
    # repeated rows of the page that is the response meet in one task, next to each other
    marked = marked.repartition("page_id", "sha1").sortWithinPartitions("page_id", "sha1")
    folder = _folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, last = _Writer(folder, file_bytes), None
        try:
            for batch in slices(batches, "html"):
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = html.encode("utf-8")
                    digest = payload_digest(payload)
                    key = (page_id, digest)
                    revisit = refers_to is not None and (page_id != refers_to or key == last)
                    last = key
                    raw = record_bytes(page_id, url, payload, digest, refers_to, revisit)
                    rows.append((*writer.add(raw), page_id, url, digest,
                                 "revisit" if revisit else "response"))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_INDEX.names, row)) for row in rows], schema=_INDEX)
        finally:
            writer.close()

    index = marked.select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX_SCHEMA)
    return stage_table(index, "warc-index")


_INDEX = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
    ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()),
])


def coalesced(
    ranges: list[tuple[str, int, int]], read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES,
) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (path, offset, length) joined into reads: path, start, end and the ranges' places."""
    path, start, end, own = None, 0, 0, []
    for i, (p, offset, length) in enumerate(ranges):
        far = p != path or offset > end + gap_bytes or max(end, offset + length) - start > read_bytes
        if own and far:
            yield path, start, end, own
            own = []
        if not own:
            path, start, end = p, offset, offset
        end = max(end, offset + length)
        own.append(i)
    if own:
        yield path, start, end, own


RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()),
])


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, each checked against its digest.

    ``selected`` has path, offset and length. Ranges are dealt by stretches of a file, so a
    large archive is read by many tasks, and sorted within a task. The payload of a revisit is
    null, its payload_bytes is that of the page it stands for. A broken record fails the job.
    """
    stretch = F.floor(F.col("offset") / READ_BYTES)
    # index rows are small whatever they point at, so tasks are counted by the bytes to read
    total = selected.agg(F.sum("length")).first()[0] or 0
    ranges = (
        selected.select("path", "offset", "length").withColumn("stretch", stretch)
        .repartition(total // READ_BYTES + 1, "path", "stretch").sortWithinPartitions("path", "offset")
        .select("path", "offset", "length")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for path, start, end, own in coalesced(rows):
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(local) as file:
                    data = file.read_at(end - start, start)
                out = []
                for i in own:
                    _, offset, length = rows[i]
                    out.append(_row(data[offset - start:offset - start + length], with_payload))
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD)

    return ranges.mapInArrow(read, RECORD_SCHEMA)


def _row(packed: bytes, with_payload: bool) -> dict:
    record = parse_record(zlib.decompress(packed, 31))
    head, revisit = record.headers, record.headers["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and payload_digest(record.payload) != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")

    def page(field):
        number = head[field][len(_ID) + 1:-1] if field in head else ""
        return int(number) if number else None

    return {
        "page_id": page("WARC-Record-ID"), "url": head["WARC-Target-URI"],
        "record_type": head["WARC-Type"], "payload_bytes": int(record.http["Content-Length"]),
        "payload_digest": digest, "refers_to": page("WARC-Refers-To"),
        "payload": record.payload if with_payload and not revisit else None,
    }
