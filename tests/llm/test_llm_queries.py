"""The registered queries on the smallest tables: against their SQL, or against their contract."""

import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardmill.llm.queries import ORACLES, QUERIES, URL_RULES
from checks.compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    problem = difference(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).fetchdf())
    assert problem is None, problem


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, len(QUERIES) + 1)]


def test_language_query(spark):
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {r.doc_id: r.held_out for r in got.values()} == {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.9 * len(held) > 0


def test_url_query(spark):
    rows = QUERIES["op2_url_filter"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    fits = lambda r, rule: (r.host == rule.split("/")[0] or r.host.endswith("." + rule.split("/")[0])) and r.path.startswith(rule[rule.index("/"):])
    for r in rows:
        assert r.rule == max((rule for rule in URL_RULES if fits(r, rule)), key=len, default=None)
        assert r.verdict == URL_RULES.get(r.rule, "block" if r.block_score >= 0.5 else "allow")


def test_shard_query(spark):
    rows = QUERIES["op9_sharding"](spark, SF).orderBy("shard", "slot").collect()
    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r["size"], r.text_crc32, r.law) for r in rows} == {(i, len(t) + 1, zlib.crc32(t), "bytes") for i, t in docs.items()}
    assert [r.doc_id for r in rows] == sorted(docs)
    assert all(r.grown_shard is None and 0 <= r.shard < 16 for r in rows)


def test_archive_query(spark):
    rows = QUERIES["op10_warc"](spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.octet_length("html").alias("n"), "html").collect()
    assert {(r.page_id, r.payload_bytes) for r in rows} == {(p.page_id, p.n) for p in pages}
    last = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        last[p.html] = p.page_id
    for r, p in zip(sorted(rows, key=lambda r: r.page_id), sorted(pages, key=lambda p: p.page_id), strict=True):
        assert (r.record_type, r.refers_to) == (("response", None) if last[p.html] == p.page_id else ("revisit", last[p.html]))
