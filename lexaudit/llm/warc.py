"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

Each derived record refers to its response by the response's own record id
(WARC-Refers-To, -Target-URI and -Date), repeats the response's payload digest
and all its HTTP headers, in their order, and has a block digest of its own.
Identifiers of derived records follow from the response's, so that a task that
runs again makes the same records. A response without an id or a payload
digest of its own gets one that follows from its page_id, url and payload.

Defined results: a null or empty payload gives a metadata record and an empty
conversion record; a null url leaves the URI headers out; a null page_id takes
part in made identifiers as an empty string; null headers are none, repeated
ones are all kept; repeated rows give repeated records; a very long page takes
time in proportion to its length; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pages as html_pages
from .plane_files import open_fs
from .store import bounded_batches, partitions, returned

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
HEADERS = "array<struct<name:string,value:string>>"
RESPONSE = f"record_id string, url string, date string, http_headers {HEADERS}, payload string, payload_digest string"
#: Bytes of payloads that one batch of read responses holds, at least one response's.
BATCH_BYTES = 4_000_000


def digest(data: bytes) -> str:
    """A labelled digest as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def made_id(*parts: str) -> str:
    """A record identifier that depends on the parts alone."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def responses(pages: DataFrame, content_type: str = "text/html; charset=utf-8", date: str = DATE) -> DataFrame:
    """Responses of a page table (page_id, url, html).

    Columns record_id, date, http_headers and payload_digest are taken over
    where the table has them; otherwise the headers are a content type and a
    server, and record_id and payload_digest are null.
    """

    def own(name: str, kind: str, other: Column) -> Column:
        return (F.col(name) if name in pages.columns else other).cast(kind).alias(name)

    http = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in (("Content-Type", content_type), ("Server", "crawl"))))
    made = [own("record_id", "string", F.lit(None)), "url", own("date", "string", F.lit(date)), own("http_headers", HEADERS, http), F.col("html").alias("payload")]
    return pages.select("page_id", *made, own("payload_digest", "string", F.lit(None)))


def derive(found: DataFrame) -> DataFrame:
    """Two rows a response (page_id and what RESPONSE names): its metadata record and its conversion record."""
    bounded_batches(found.sparkSession)
    names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "payload_digest", "block_digest", "block"]
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3]

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [made for row in batch.to_pylist() for made in _derived(**row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, kinds, strict=True))
    given = found.select(F.col("page_id").cast("long").alias("page_id"), "record_id", "url", "date", "http_headers", "payload", "payload_digest")
    return given.mapInArrow(run, schema)


def _derived(page_id: int | None, record_id: str | None, url: str | None, date: str | None, http_headers: list[dict] | None, payload: str | None, payload_digest: str | None) -> list[tuple]:
    payload = payload or ""
    source = payload_digest or digest(payload.encode())
    refers = record_id or made_id("response", "" if page_id is None else str(page_id), url or "", source)
    text, title, lang, links = html_pages.read(payload)
    fields = [("title", title), ("language", lang), ("source-digest", source)]
    fields += [(f"source-header-{html_pages.one_line(h['name'] or '')}", html_pages.one_line(h["value"] or "")) for h in http_headers or () if h]
    fields += [("outlink", x) for x in links]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields if v)
    out = []
    for kind, type_, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode()
        out.append((page_id, kind, made_id(kind, refers), refers, url, date, type_, len(data), source, digest(data), block))
    return out


# ---- WARC files ----


def serialize(row: dict) -> bytes:
    """A derived record as WARC 1.1 bytes."""
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Refers-To", row["refers_to"])]
    if row["target_uri"] is not None:
        head += [("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To-Target-URI", row["target_uri"])]
    head += [("WARC-Refers-To-Date", row["date"]), ("WARC-Source-Payload-Digest", row["payload_digest"]), ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {html_pages.one_line(v)}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + row["block"].encode() + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Header fields in order; a line that starts with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        said = line.decode("utf-8", "replace").rstrip("\r\n")
        if said[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {said.strip()}"
        elif ":" in said:
            name, _, value = said.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(stream: BinaryIO) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header fields, block) of each record in a stream of plain WARC bytes, one record in memory at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        fields = _fields(lines)
        yield fields, stream.read(int(_first(fields, "content-length") or 0))


def _first(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name), None)


def opened(path: str) -> BinaryIO:
    """A file of plain or gzipped WARC records, as a stream of plain bytes."""
    where, inner = open_fs(path)
    file = io.BufferedReader(where.open_input_stream(inner, compression=None))
    return gzip.GzipFile(fileobj=file) if file.peek(2)[:2] == b"\x1f\x8b" else file


def response_of(fields: list[tuple[str, str]], block: bytes) -> tuple:
    """The values that RESPONSE names, of a response record; the payload in the charset of its content type."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = _fields(head.split(b"\r\n")[1:])
    charset = (_first(http, "content-type") or "").lower().partition("charset=")[2].split(";")[0].strip("\"' ") or "utf-8"
    try:
        payload = body.decode(charset, "replace")
    except LookupError:
        payload = body.decode("utf-8", "replace")
    return _first(fields, "warc-record-id"), _first(fields, "warc-target-uri"), _first(fields, "warc-date"), [{"name": k, "value": v} for k, v in http], payload, _first(fields, "warc-payload-digest") or digest(body)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, with a null page_id; files are streamed, a record at a time."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.string(), pa.string()]
    names = ["record_id", "url", "date", "http_headers", "payload", "payload_digest"]

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                rows, size = [], 0
                for fields, block in parse(opened(file)):
                    if _first(fields, "warc-type") == "response":
                        rows.append(response_of(fields, block))
                        size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path").repartition(partitions(spark))
    return files.mapInArrow(run, RESPONSE).select(F.lit(None).cast("long").alias("page_id"), "*")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write derived records as .warc.gz files, a gzip member a record and a file a task; returns (path, n_records).

    Names are new in each run of a task: files that the result does not name
    are left over from lost tasks.
    """

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    where, inner = open_fs(path)
                    where.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(inner, compression=None)
                out.write(gzip.compress(serialize(row), mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return records.mapInArrow(run, "path string, n_records long")
