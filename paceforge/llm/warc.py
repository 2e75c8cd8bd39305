"""WARC archives: writing captures and assembling them back.

A capture is three records that name each other: the request and the metadata
carry the response's (or revisit's) record id in WARC-Concurrent-To. The writer
is Spark's text writer, whose line separator is the blank lines that end a
record, so archives are committed like any table and a lost task writes its
file anew. The reader parses each file as a stream of Content-Length records;
the transaction assembly joins the three kinds by record id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import map_batches, scratch_dir, store

VERSION, END = b"WARC/1.0", b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, date string, digest string, page_id long, length long, headers string, payload binary, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    """The same for the same capture, so that a task that runs again writes the same file."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(f'{kind}|{page_id}|{digest}'.encode(), digest_size=16).digest(), version=4)}>"


def one_line(value: str | None) -> str:
    """A header value cannot hold line breaks or control signs; they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def format_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its final blank lines."""
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8") for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block


def capture_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> list[bytes]:
    """The three records of one capture. A revisit has no payload, but its digest and length."""
    digest, target = base32_sha1(payload), one_line(url)
    kind = "response" if refers_to is None else "revisit"
    main = record_id("capture", page_id, digest)
    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
    page = [] if page_id is None else [("X-Page-Id", str(page_id))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    about = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), *page]
    if kind == "revisit":
        about += [("WARC-Refers-To", record_id("capture", refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    host, _, path = target.partition("://")[2].partition("/")
    request = f"GET /{path.partition('#')[0]} HTTP/1.1\r\nHost: {host}".encode("utf-8") + END
    metadata = b"page_id: %s\r\nrefers_to: %s\r\n" % tuple(str(v if v is not None else "").encode() for v in (page_id, refers_to))
    return [
        format_record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, digest)), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http; msgtype=request")], request),
        format_record([("WARC-Type", kind), ("WARC-Record-ID", main), *common, *about], http + (payload if kind == "response" else b"")),
        format_record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, digest)), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/warc-fields")], metadata),
    ]


#: A file holds at most so many bytes of records, before compression, or one capture.
FILE_BYTES = 1 << 30


def write_archives(pages: DataFrame, path: str, records_per_file: int = 6000, min_revisit_bytes: int = 0) -> None:
    """Write one capture per ``pages`` row (page_id, url, html) as gzipped WARC files under ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, that
    with the largest page_id is the response, the others revisit it; smaller
    payloads are all responses. A null html is an empty payload. Null page_ids
    come before all others. Rows that repeat the page_id and html of the
    response are the same capture, with the same record ids. A file holds at
    most ``records_per_file`` records, and fewer where the largest page would
    take it beyond ``FILE_BYTES``.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    largest = rows.agg(F.max(F.octet_length("html") + 3 * F.octet_length(F.coalesce("url", F.lit(""))))).first()[0] or 0
    records_per_file = max(3, min(records_per_file, 3 * (FILE_BYTES // (largest + 4096))))
    # only payloads that occur again need a decision; their digests and ids are all that is aggregated
    again = rows.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha1", "last")
    marked = rows.join(again, "sha1", "left")
    other = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")) & (F.octet_length("html") >= min_revisit_bytes)
    captures = marked.select("page_id", "url", "html", F.when(other, F.col("last")).alias("refers_to"))

    def make():
        def run(batch):
            cols = [batch.column(i).to_pylist() for i in range(4)]
            out = []
            for page_id, url, html, refers_to in zip(*cols):
                out += capture_records(page_id, url, html.encode("utf-8"), refers_to)
            return [pa.array(out, pa.binary())]

        return run

    records = map_batches(captures, "record binary", make)
    # the text writer ends each value with the separator, which makes it a record; bytes pass through as they are
    records.select(F.col("record").cast("string").alias("value")).write.options(lineSep=END.decode(), compression="gzip", maxRecordsPerFile=records_per_file).mode("overwrite").text(path)


class _Archive:
    """The bytes of an archive in turn; what was read can be put back."""

    def __init__(self, data: bytes):
        self.stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
        self.held = io.BytesIO()

    def line(self) -> bytes:
        head = self.held.readline()
        return head if head.endswith(b"\n") else head + self.stream.readline()

    def read(self, size: int) -> bytes:
        head = self.held.read(size)
        return head + self.stream.read(size - len(head)) if len(head) < size else head

    def put_back(self, data: bytes) -> None:
        self.held = io.BytesIO(data + self.held.read())


def parse_archive(data: bytes):
    """Yield (headers, block) of each record of an archive, compressed whole, by record or not at all; one record is held at a time.

    What is no record gives one (None, error), and reading goes on at the next
    version line. A record ends with two line ends or the archive; where its
    block does not, its length is wrong, and version lines are looked for from
    the block's first byte on. A compressed stream that breaks ends with an
    error, too.
    """
    archive, lost = _Archive(data), False
    try:
        while line := archive.line():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                if not lost:
                    yield None, "a WARC record has no version line"
                lost = True
                continue
            headers, read = {}, []
            while (line := archive.line()).strip():
                read.append(line)
                name, _, value = line.partition(b":")
                headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            size = _number(headers.get("content-length"))
            if size is None or size < 0:
                archive.put_back(b"".join(read) + line)
                yield None, "a WARC record has no length"
                lost = True
                continue
            block = archive.read(size)
            after = archive.read(len(END)) if len(block) == size else b""
            if len(block) < size or after.strip():
                archive.put_back(block + after)
                yield None, "a WARC block does not end where its length says"
                lost = True
                continue
            lost = False
            yield headers, block
    except (EOFError, OSError, zlib.error) as error:
        yield None, str(error)


def _number(value: str | bytes | None) -> int | None:
    """A count or id of at most 18 digits; null if it is none."""
    text = value.decode("ascii", "replace") if isinstance(value, bytes) else value or ""
    return int(text) if text.isascii() and text.lstrip("-").isdigit() and text.count("-") <= 1 and len(text) < 19 else None


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; without ``payloads`` their bytes are left out, not their digests.

    A part of an archive that is no record gives a row of which only ``error``
    is set, and the records after it are read (``parse_archive``). A page id or
    length that is no number is null. An empty file has no records.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parsed(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("warc-type")
        http, _, payload = block.partition(END) if kind in ("response", "revisit", "request") else (block, b"", b"")
        fields = dict(line.lower().replace(b" ", b"").split(b":", 1) for line in http.split(b"\r\n")[1:] if b":" in line)
        page, whole = headers.get("x-page-id"), kind == "response"
        digest = base32_sha1(payload) if whole else headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        length = len(payload) if whole else _number(fields.get(b"content-length")) if kind == "revisit" else None
        ids = (headers.get(k) for k in ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date"))
        return (*ids, digest, _number(page), length, http.decode("utf-8", "replace"), payload if payloads and whole else None, None)

    def make():
        def run(batch):
            rows = []
            for data in batch.column(0):
                for headers, block in parse_archive(data.as_py()):
                    rows.append((*[None] * 11, block) if headers is None else parsed(headers, block))
                    if len(rows) >= 500:
                        yield [list(c) for c in zip(*rows)]
                        rows = []
            if rows:
                yield [list(c) for c in zip(*rows)]

        return run

    return map_batches(files, RECORD, make)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, page_id, target_uri, record_type, digest, length, refers_to, request, response, metadata).

    Requests and metadata meet their response or revisit by WARC-Concurrent-To;
    a capture without one of them has null there, and records that name no
    capture at hand are left out. Of requests or metadata that name the same
    capture the one with the smallest record id is taken. Captures that were
    written several times, under one record id, give as many rows.
    ``refers_to`` is the page_id of the response that a revisit names.
    """
    part = F.struct("record_id", "date", "headers")
    main = records.where("warc_type in ('response', 'revisit')")
    once = main.groupBy("record_id").agg(*[F.first(c).alias(c) for c in ("warc_type", "refers_to", "target_uri", "date", "digest", "page_id", "length", "headers", "payload")], F.count("*").cast("int").alias("times"))
    side = records.where("warc_type in ('request', 'metadata') and concurrent_to is not null").groupBy(F.col("concurrent_to").alias("record_id"))
    parts = side.agg(*[F.min(F.when(F.col("warc_type") == kind, part)).alias(kind) for kind in ("request", "metadata")])
    named = main.where("warc_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("page_id").alias("response_page"))
    return (
        once.join(parts, "record_id", "left")
        .join(named, "refers_to", "left")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), "times")))
        .select("record_id", "page_id", "target_uri", F.col("warc_type").alias("record_type"), "digest", "length", F.col("response_page").alias("refers_to"), "request", F.struct("date", "headers", "payload").alias("response"), "metadata")
    )


def write_and_assemble(pages: DataFrame, records_per_file: int = 6000) -> DataFrame:
    """Archive all pages in the shared folder, read the archives back and return one row per page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, complete);
    ``complete`` tells that request and metadata were found.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, records_per_file)
    # the archives are parsed once; without payloads the records are small
    return assemble(store(read_records(spark, path, payloads=False))).select(
        "page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", (F.col("request").isNotNull() & F.col("metadata").isNotNull()).alias("complete")
    )
