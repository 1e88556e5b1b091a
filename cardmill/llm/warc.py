"""WARC archives: pages written as request, response or revisit, and metadata records, and captures assembled from records.

Writing: of records with equal payloads the one with the largest page id is a response and the others revisit it. Every
page's three records share the identifier of its response or revisit through WARC-Concurrent-To. Files are gzipped, of a
bounded number of pages each, and written and read by Spark's own sinks and sources, so any store will do.

Reading: files of WARC 1.0 and 1.1 are cut at version lines by the text source and put together again by Content-Length, one
record at a time, so that payloads may hold such lines. Bytes that are no record, and a file that ends within one, are an
error that names the file. Captures are the records that share a concurrent-to identifier, one nested row each.

Defined results: a null page is an empty payload. Rows with equal payloads and the largest page id are all responses, and
repeated rows are captures each. A null page id is smaller than any other and is read back as null. Control characters in
a url are percent-encoded in headers. A very long page is one record of one file. Page ids are whole numbers. A capture without a response or revisit record has null there. Extra columns of the
pages are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm.tables import materialize

FAMILY = "WARC/1."  # every record begins with it, and a version that is read
VERSIONS = (b"0\r\n", b"1\r\n")
VERSION = "WARC/1.1\r\n"  # of records written here
DATE = "2024-01-01T00:00:00Z"  # of all records written here, as pages carry no time
PAGES_PER_FILE = 5_000
FILE_BYTES = 128 << 20  # of payloads of a file, on the average
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_type string, record_id string, concurrent_to string, target_uri string, refers_to string, payload_digest string, fields map<string,string>, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block.encode())))])
    return f"{VERSION}{lines}\r\n{block}"


def page_records(page_id: int | None, url: str | None, html: str | None, keeper: int | None, is_response: bool, place: str) -> list[str]:
    """The three records of one page."""
    payload = html or ""
    size, digest = len(payload.encode()), base32_sha1(payload.encode())
    main = f"<urn:capture:{page_id}:{digest}#{place}>"
    uri = [("WARC-Target-URI", header_value(url))] if url else []
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    path = re.sub(r"^[^:]*://[^/]*", "", header_value(url or "")) or "/"
    request = record("request", [("WARC-Record-ID", f"<urn:request:{place}>"), ("WARC-Concurrent-To", main), *uri, ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1\r\n\r\n")
    common = [("WARC-Record-ID", main), *uri, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if is_response:
        capture = record("response", common, head + payload)
    else:
        capture = record("revisit", [*common, ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:capture:{keeper}:{digest}>")], head)
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    metadata = record("metadata", [("WARC-Record-ID", f"<urn:metadata:{place}>"), ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], f"{fields}payload-length: {size}\r\n")
    return [request, capture, metadata]


def write_archive(pages: DataFrame, path: str, pages_per_file: int = PAGES_PER_FILE) -> None:
    """Pages (page_id, url, html) as WARC files in a new folder. One shuffle, by payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    # written, so that the join can broadcast a small one and split hot payloads of a large one
    keepers = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"), F.max(F.octet_length("html")).cast("long").alias("bytes")))
    n, size = keepers.agg(F.sum("n"), F.sum(F.coalesce("bytes", F.lit(0)))).first()  # the payload of a revisit is not written
    pages_per_file = max(1, min(pages_per_file, FILE_BYTES * (n or 0) // max(1, size or 0)))
    keepers = keepers.select("digest", "keeper")
    # a revisit needs no payload, but its size and digest are those of the whole one
    met = rows.join(keepers, "digest").select("page_id", "url", "html", "keeper", F.col("page_id").eqNullSafe(F.col("keeper")).alias("is_response"))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += page_records(*row, f"{part}-{n}")
                n += 1
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    records = met.mapInArrow(run, "value string")
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 3 * pages_per_file).option("compression", "gzip").text(path)


def parse(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}


def parsed(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """One record's row."""
    kind = headers.get("warc-type")
    payload, fields = None, {}
    if kind == "response" and headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind in ("response", "resource"):
        payload = block
    elif headers.get("content-type", "") == "application/warc-fields":
        fields = parse(block)
    digest = base32_sha1(payload) if payload is not None else headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return {
        "record_type": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"), "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to"), "payload_digest": digest, "fields": list(fields.items()),
        "payload_bytes": None if payload is None else len(payload), "payload": payload if with_payload else None,
    }


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the gzipped WARC files in a folder, one file a task, one record at a time."""
    kind = pa.schema([(n, pa.map_(pa.string(), pa.string()) if n == "fields" else pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string())
                      for n in ("record_type", "record_id", "concurrent_to", "target_uri", "refers_to", "payload_digest", "fields", "payload_bytes", "payload")])

    def run(batches):
        pending, place = [], None  # pieces of a record whose payload holds version lines, and its file

        def cut_off() -> ValueError:
            return ValueError(f"no whole WARC record at the end of {place}: {FAMILY.encode().join(pending)[:80]!r}")

        for batch in batches:
            out, held = [], 0
            for piece, file in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != place:
                    if pending:
                        raise cut_off()
                    place = file
                if not pending and not piece.strip():
                    continue
                if not pending and not piece.startswith(VERSIONS):
                    raise ValueError(f"no WARC record in {file}: {piece[:80]!r}")
                pending.append(piece)
                head, ended, rest = FAMILY.encode().join(pending)[3:].partition(b"\r\n\r\n")
                headers = parse(head)
                length = int(headers.get("content-length", 0))
                if not ended or len(rest) < length:
                    continue
                if rest[length:].strip():
                    raise ValueError(f"bytes after a WARC record in {file}: {rest[length:][:80]!r}")
                pending = []
                out.append(parsed(headers, rest[:length], with_payload))
                held += length if with_payload else 0
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if pending:
            raise cut_off()

    lines = spark.read.option("lineSep", FAMILY).text(path).select("value", "_metadata.file_path")
    return lines.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit record, its requests and its metadata."""
    entry = F.struct("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", F.map_entries("fields").alias("fields"))

    def of(*kinds: str) -> Column:
        return F.collect_list(F.when(F.col("record_type").isin(*kinds), entry))

    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.get(of("response", "revisit", "resource"), F.lit(0)).alias("capture"), of("request").alias("requests"), of("metadata").alias("metadata")
    )


def page_captures(found: DataFrame) -> DataFrame:
    """The captures of ``write_archive`` by page: what was archived, and for a revisit the page it refers to."""
    fields = F.map_from_entries(F.get("metadata", F.lit(0))["fields"])
    size = F.coalesce("capture.payload_bytes", fields["payload-length"].cast("long"))  # a revisit holds no payload to measure
    return found.select(
        fields["page-id"].cast("long").alias("page_id"), size.alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"), F.regexp_extract("capture.refers_to", r"^<urn:capture:([0-9-]+):", 1).try_cast("long").alias("refers_to"), "capture_id", "capture", "requests",
    )
