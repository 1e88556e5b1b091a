"""Shards and archives: exact round trips."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardmill.llm import sharding, warc


def test_shards(spark, rows, docs, no_docs):
    sized = docs.withColumns({"size": sharding.byte_size(F.col("text")), "crc": F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "slot": F.lit("clash")})
    got = sharding.contiguous_shards(sized, ["doc_id", "crc"], "size", 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, r.crc) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total = sum(r.size for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(-1 if r.doc_id is None else r.doc_id, r.crc) for r in order] == sorted((-1 if r.doc_id is None else r.doc_id, r.crc) for r in got)
    for shard in range(4):
        own = [r for r in order if r.shard == shard]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) <= max(r.size for r in got)
    assert sharding.contiguous_shards(no_docs.withColumn("size", F.lit(1)), ["doc_id"], "size", 4).collect() == []


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (7, "http://a/7?x=\r\ny", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://b", None), (5, "http://c", ""), (6, "http://d", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (None, "http://e", "<p>same</p>"), (None, None, None), (8, "http://f", "WARC/1.1\r\n"), (9, "http://f", "x" * 300_000), (10, "u", "twice"), (10, "u", "twice"), (11, "http://g", "\r\n\r\n"),
]


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    folder = str(tmp_path / "warc")
    warc.write_archive(pages, folder, pages_per_file=2)
    records = warc.read_records(spark, folder)
    got = warc.page_captures(warc.captures(records)).collect()
    best = {}
    for i, _, html in PAGES:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        top = best[html or ""]
        response = top == (-1 if i is None else i)
        want.append((-1 if i is None else i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else top))
    assert sorted(map(str, want)) == sorted(str((-1 if r.page_id is None else r.page_id, *r[1:5])) for r in got)
    for r in got:
        assert len(r.requests) == 1 and r.requests[0].record_type == "request"
        if r.record_type == "response":
            assert len(bytes(r.capture.payload)) == r.payload_bytes
    # any reader of the format finds the same records in the files
    found = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder).glob("part-*"))
    kinds, at = [], 0
    while at < len(found):
        end = found.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in found[at:end].decode().split("\r\n")[1:])
        kinds.append(headers["WARC-Type"])
        at = end + 4 + int(headers["Content-Length"])
        assert found[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert sorted(set(kinds)) == ["metadata", "request", "response", "revisit"] and len(kinds) == 3 * len(PAGES)


def test_archive_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.page_captures(warc.captures(warc.read_records(spark, folder))).collect() == []


def test_captures_of_other_archives(spark, tmp_path):
    """Records without their partners, and a capture with two metadata records."""
    head = lambda kind, name, to="": f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n" + (f"WARC-Concurrent-To: <{to}>\r\n" if to else "")
    text = "".join(h + "Content-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n" for h in (
        head("warcinfo", "i"), head("request", "q", "r1"), head("metadata", "m1", "r2"), head("metadata", "m2", "r2"), head("response", "r2")))
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(text.encode()))
    got = {r.capture_id: r for r in warc.captures(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<i>", "<r1>", "<r2>"}
    assert got["<r1>"].capture is None and len(got["<r1>"].requests) == 1
    assert len(got["<r2>"].metadata) == 2 and bytes(got["<r2>"].capture.payload) == b"a: b"


def archive_of(version, *blocks):
    """Records of one version with these blocks, and a header that holds a version line's beginning."""
    out = b""
    for k, block in enumerate(blocks):
        out += f"WARC/{version}\r\nWARC-Type: resource\r\nWARC-Record-ID: <r{k}>\r\nSoftware: WARC/1.x\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


def test_both_versions_are_read(spark, tmp_path):
    blocks = [b"one", b"", b"WARC/1.0\r\n\r\nWARC/1.1\r\n", b"\r\n\r\n", b"\xff\xfe five"]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(archive_of("1.0", *blocks)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(archive_of(v, b)) for v, b in (("1.1", b"x"), ("1.0", b"y"))))  # a member for each record
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted([*blocks, b"x", b"y"])
    assert all(r.payload_bytes == len(r.payload) for r in got)


@pytest.mark.parametrize("content,message", [
    (archive_of("1.1", b"whole", b"cut off here")[:-12], "no whole WARC record"),
    (archive_of("1.0", b"whole")[:40], "no whole WARC record"),
    (b"no archive at all", "no WARC record"),
    (archive_of("1.1", b"whole") + b"more bytes", "bytes after a WARC record"),
    (b"WARC/2.0\r\n" + archive_of("1.1", b"whole"), "no WARC record"),
])
def test_bytes_that_are_no_record(spark, tmp_path, content, message):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(content))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(archive_of("1.1", b"good")))
    with pytest.raises(Exception, match=message):
        warc.read_records(spark, str(tmp_path)).collect()
