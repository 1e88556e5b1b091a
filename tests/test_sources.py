import json
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cardmill.plans.rate import rate_sheet
from cardmill.session import work_dir
from cardmill.sources import capture, sheets, sites
from cardmill.streaming.harvest import append_first_seen

GOOD = {"name": "Acme", "slug": "acme", "start_url": "https://a.com", "dom": {"card": {"candidates": ["li"]}, "fields": {"title": {"selectors": ["a"]}}}}


@pytest.fixture
def config_dir(tmp_path):
    docs = {
        "b-acme.json": GOOD | {"schema_version": 1, "future": {"x": 1}},
        "a-beta.json": GOOD | {"slug": "beta", "search": {"query": "dev"}, "pagination": {"type": "scroll", "max_pages": 2}, "notes": ["n"]},
        "no-name.json": {k: v for k, v in GOOD.items() if k != "name"},
        "no-card.json": GOOD | {"dom": {"fields": {}}},
        "enum.json": GOOD | {"pagination": {"type": "sideways"}},
        "submit.json": GOOD | {"search": {"query": "x", "submit": "shout"}},
        "type.json": GOOD | {"pagination": {"max_pages": "many"}},
        "popup.json": GOOD | {"popups": [{"fingerprint": {}}]},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "broken.json").write_text('{"name": "A", ')
    (tmp_path / "notes.txt").write_text("not a config")
    return str(tmp_path)


def test_read_site_configs(spark, config_dir):
    rows = sites.read_site_configs(spark, config_dir).collect()
    assert [r.stem for r in rows] == ["a-beta", "b-acme"]
    beta, acme = rows
    assert (beta.search.submit, beta.pagination.type, beta.pagination.max_pages, beta.notes) == ("enter", "scroll", 2, ["n"])
    assert (acme.schema_version, acme.pagination.type, acme.pagination.max_pages, acme.popups, acme.search) == (1, "none", 5, [], None)
    assert acme.onboarded_job_count == 0 and acme.onboarded_at
    rejected = {r.stem: r.reject_reason for r in sites.rejected_site_configs(spark, config_dir).collect()}
    assert set(rejected) == {"no-name", "no-card", "enum", "submit", "type", "popup", "broken"}
    assert rejected["no-name"] == "name is missing" and rejected["enum"].startswith("pagination.type is not one of")
    assert [r.slug for r in sites.read_site_configs(spark, config_dir, ["B Acme!"]).collect()] == ["acme"]


def test_upsert_and_json(spark, config_dir):
    old = sites.read_site_configs(spark, config_dir).drop("stem")
    new = old.filter("slug = 'acme'").withColumn("name", F.lit("New")).unionByName(old.filter("slug = 'beta'").withColumn("slug", F.lit("gamma")))
    merged, refused = sites.upsert_site_configs(old, new)
    assert {(r.slug, r.name) for r in merged.collect()} == {("acme", "Acme"), ("beta", "Acme"), ("gamma", "Acme")}
    assert [r.slug for r in refused.collect()] == ["acme"]
    forced, refused = sites.upsert_site_configs(old, new, force=True)
    assert {(r.slug, r.name) for r in forced.collect()} == {("acme", "New"), ("beta", "Acme"), ("gamma", "Acme")} and refused.count() == 0
    doc = json.loads(sites.sites_to_json(old).filter("slug = 'acme'").first().document)
    assert "search" not in doc and "control" not in doc["pagination"] and doc["dom"]["card"]["candidates"] == ["li"]


def test_capture_plan(spark):
    big = 15 * 1024 * 1024
    rows = [(1, 200, "fetch", "application/json; charset=x", 10), (2, 301, "document", "text/html", 10), (3, 200, "image", "image/png", 10),
            (4, 200, "script", "text/javascript", big), (5, 200, "xhr", "text/plain", big + 1), (123456, 200, "document", None, 1),
            (7, 200, "fetch", "application/xhtml+xml", None)]
    df = spark.createDataFrame(rows, "id long, status int, resource_type string, content_type string, body_bytes long")
    got = {r.id: (r.ext, r.wants_body, r.body_file, r.body_skipped) for r in capture.capture_body_plan(df).collect()}
    assert got == {
        1: (".json", True, "bodies/00001.json", None), 2: (".html", False, None, None), 3: (".bin", False, None, None),
        4: (".js", True, "bodies/00004.js", None), 5: (".txt", True, None, "too large"), 123456: (".bin", True, "bodies/123456.bin", None),
        7: (".html", True, None, None),
    }
    data = {r.id: r.wants_body for r in capture.capture_body_plan(df, "data").collect()}
    assert data[4] is False and data[1] is True


def test_capture_index(spark, tmp_path):
    line = {"id": 1, "ts": 1700000000.5, "url": "https://x/api", "method": "GET", "status": 200, "resource_type": "fetch",
            "content_type": "application/json", "request_headers": {"a": "b"}, "response_headers": {}, "post_data": None, "frame_url": None}
    (tmp_path / "index.jsonl").write_text(json.dumps(line) + "\n")
    r = capture.read_capture_index(spark, str(tmp_path)).first()
    assert (r.id, r.request_headers, r.at.microsecond, r.body_file) == (1, {"a": "b"}, 500000, None)


def test_sheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("Acme", "Engineer\x07", 10, "https://x.com/1", None, "x", ["a", None]), ("B", 'two\n"lines", q', 2, None, None, "y", [])],
        "company string, title string, score int, apply_url string, location string, custom string, department array<string>",
    )
    projected = sheets.export_projection(df)
    assert projected.columns == ["Company", "Title", "Department", "Score", "Apply URL"]
    assert [r.Department for r in projected.collect()] == ["a, None", ""]
    sheets.write_job_sheet(df, f"{tmp_path}/sheet")
    rows = sheets.read_job_sheet(spark, f"{tmp_path}/sheet").orderBy("company").collect()
    assert rows[0].asDict() == {"company": "Acme", "title": "Engineer", "department": "a, None", "score": "10", "apply_url": "https://x.com/1"}
    assert (rows[1].title, rows[1].apply_url, rows[1].department) == ('two\n"lines", q', None, None)
    assert sheets.export_projection(df.select("custom")).columns == ["Company", "Title", "Location"]
    long = spark.createDataFrame([("x" * 40000,)], "title string")
    assert len(sheets.export_projection(long).first().Title) == 40000
    assert len(sheets.export_projection(long, max_chars=32000).first().Title) == 32000
    assert sheets.sheet_key("My  Own-Label!") == "my_own_label"


def test_rate_sheet(spark, tmp_path):
    df = spark.createDataFrame([("A", "low", 1), ("B", "high", 9), ("C", "mid", 5)], "company string, title string, score int")
    sheets.write_job_sheet(df, f"{tmp_path}/in")
    rate = lambda prompts: ['{"fit": "Yes", "score": 3, "reason": "r"}' for _ in prompts]
    rated = rate_sheet(spark, f"{tmp_path}/in", f"{tmp_path}/out", rate, limit=2)
    assert {r.title: (r.ai_fit, r.ai_score) for r in rated.collect()} == {"high": ("Yes", "3"), "mid": ("Yes", "3"), "low": (None, None)}


def test_append_first_seen_repeats_safely(spark, tmp_path):
    table = f"{tmp_path}/rows"
    make = lambda *rows: spark.createDataFrame(list(rows), "slug string, page_no int, pos int, apply_url string")
    first, second = make(("a", 1, 1, "u"), ("a", 1, 2, "u"), ("b", 1, 1, "u")), make(("a", 2, 1, "u"), ("a", 2, 2, "v"))
    for batch_id, rows in ((0, first), (1, second), (1, second)):
        append_first_seen(rows, batch_id, table)
    got = sorted((r.slug, r.job_key, r.page_no, r.pos) for r in spark.read.parquet(table).collect())
    assert got == [("a", "u", 1, 1), ("a", "v", 2, 2), ("b", "u", 1, 1)]


class FakeSession:
    """Only what ``work_dir`` asks of a session."""

    def __init__(self, master, shared):
        self.conf = {"spark.checkpoint.dir": shared} if shared else {}
        self.sparkContext = SimpleNamespace(master=master, applicationId="app-1")


def test_work_dir_comes_from_the_session():
    assert work_dir(FakeSession("spark://x", "hdfs://shared/")).startswith("hdfs://shared/")
    assert Path(work_dir(FakeSession("local[2]", None))).parent.parent.is_dir()
    with pytest.raises(ValueError):
        work_dir(FakeSession("spark://x", None))


def test_remembered_keys_bound_what_a_batch_reads(spark, tmp_path):
    """With a memory of three batches the log of keys stays as large, and a key comes back after as many without it."""
    table = f"{tmp_path}/rows"
    make = lambda *urls: spark.createDataFrame([("a", 1, k, u) for k, u in enumerate(urls)], "slug string, page_no int, pos int, apply_url string")
    size = []
    for batch_id in range(8):
        rows = make("often", "once" if batch_id in (0, 6) else f"u{batch_id}", f"v{batch_id}")
        for _ in range(2):  # a batch that is repeated gives the same table
            append_first_seen(rows, batch_id, table, remember=3)
        size.append(sum(p.stat().st_size for p in Path(f"{table}-keys").rglob("*.parquet")))
    got = sorted((r.batch_id, r.job_key) for r in spark.read.parquet(table).collect())
    want = [(0, "often"), (0, "once"), (6, "once")] + [(k, f"u{k}") for k in range(8) if k not in (0, 6)] + [(k, f"v{k}") for k in range(8)]
    assert got == sorted(want)
    assert max(size[4:]) <= 1.2 * size[3]
