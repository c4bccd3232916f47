"""Operator 10: WARC archives of pages, written one gzip member per record and read back sequentially.

An archive is the concatenation of its segments' bytes and a valid .warc.gz file. Archives are kept as rows
(archive, segment, n_records, data) in a Parquet folder, so Spark's committer writes them on any file system
and a lost executor's archive is written again; a segment ends at a record's end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

SEGMENT_BYTES, READ_BYTES = 4 << 20, 64 << 10
ARCHIVE_SCHEMA = "archive int, segment int, n_records int, data binary"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; refers_to makes it a revisit, whose block is the HTTP head alone."""
    http = HTTP_HEAD.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        *([("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        *([("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zip_.compress(text + block + b"\r\n\r\n") + zip_.flush()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a run of gzip members.

    Each member is decompressed READ_BYTES at a time; its header ends at the first blank line, its block
    has Content-Length bytes, and two line ends close it. A block digest that differs, a short block or
    a member without its end raises ValueError.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        unzip, got, head, need, digest = zlib.decompressobj(31), bytearray(), None, 0, hashlib.sha1()
        block: list[bytes] = []
        while not unzip.eof:
            if at >= len(view):
                raise ValueError("a gzip member ends too early")
            piece = view[at : at + READ_BYTES]
            got += unzip.decompress(piece)
            at += len(piece) - len(unzip.unused_data)
            if head is None and (end := got.find(b"\r\n\r\n")) >= 0:
                first, *lines = bytes(got[:end]).decode().split("\r\n")
                if first.encode() != VERSION:
                    raise ValueError(f"not a record of this version: {first[:40]!r}")
                head = dict(line.split(": ", 1) for line in lines)
                need = int(head["Content-Length"])
                del got[: end + 4]
            if head is not None and need:
                part = bytes(got[:need])
                digest.update(part)
                block.append(part)
                need -= len(part)
                del got[: len(part)]
        if head is None or need or got != b"\r\n\r\n":
            raise ValueError("a record's block does not have its Content-Length")
        if head["WARC-Block-Digest"] != "sha1:" + base64.b32encode(digest.digest()).decode():
            raise ValueError(f"{head['WARC-Record-ID']}: the block does not match its digest")
        yield head, b"".join(block)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with refers_to: the page that holds the payload, null for responses.

    Of rows with equal payloads of at least min_bytes bytes the largest page_id is the response. Rows of
    that same page_id (repeated rows) and rows without page_id are responses too. Payloads are equal where
    their SHA-256 is; the records' own label is SHA-1. Digests are counted
    before they meet the pages again, and Spark can split a frequent digest in that join.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    known = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    held = known.where("n > 1").select("digest", "holder")
    differs = (F.col("page_id") != F.col("holder")) & (F.octet_length("payload") >= min_bytes)
    return rows.join(held, "digest", "left").select("page_id", "url", "payload", F.when(differs, F.col("holder")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Write a record per row of pages(page_id, url, html) to archives at path.

    A null html is an empty payload; a null url leaves WARC-Target-URI out, control characters and
    spaces in it are percent-encoded. Other columns are ignored. No rows: no archives.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, segment, held, n = TaskContext.get().partitionId(), 0, bytearray(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    held += record_bytes(row["page_id"], row["url"], row["payload"], row["refers_to"], date)
                    n += 1
                    if len(held) >= SEGMENT_BYTES:
                        yield _segment(archive, segment, n, bytes(held))
                        segment, held, n = segment + 1, bytearray(), 0
        if n:
            yield _segment(archive, segment, n, bytes(held))

    with_revisits(pages, min_bytes).mapInArrow(write, ARCHIVE_SCHEMA).write.parquet(path)


def _segment(archive: int, segment: int, n: int, data: bytes) -> pa.RecordBatch:
    arrays = [pa.array([archive], pa.int32()), pa.array([segment], pa.int32()), pa.array([n], pa.int32()), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["archive", "segment", "n_records", "data"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path; a revisit has no payload but its full payload's size and digest.

    Payload digests of responses are verified as well as all block digests.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda uri: int(uri[len("<urn:x-page:") : -1]) if uri and uri != "<urn:x-page:>" else None
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for head, block in read_records(data.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    if kind == "response" and (size, digest) != (len(payload), base32_sha1(payload)):
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
                    rows.append((page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, page(head.get("WARC-Refers-To")), size, digest, payload if kind == "response" else None))
                    held += len(payload)
                    if held >= SEGMENT_BYTES:
                        yield _records(rows)
                        rows, held = [], 0
                if rows:
                    yield _records(rows)

    return spark.read.schema(ARCHIVE_SCHEMA).parquet(path).select("data").mapInArrow(read, RECORD_SCHEMA)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
