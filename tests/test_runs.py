import random
from pathlib import Path

from pyspark.sql import functions as F

from cardmill.operators.health import health_history, health_snapshot, run_summary, site_listing, site_run_status
from cardmill.sources.sites import SITE_SCHEMA, with_defaults
from cardmill.streaming.health import update_health

RUNS = "slug string, name string, run_at date, status string, n_jobs int, pages int, error string, onboarded_job_count int"


def run_rows(seed, sites=3, runs=40):
    rng = random.Random(seed)
    rows = []
    for s in range(sites):
        for i in range(runs):
            status = rng.choice(["ok", "ok", "ok", "empty", "error", "blocked"])
            n = rng.randint(1, 60) if status == "ok" else 0
            day = f"2024-{1 + i // 20:02d}-{1 + i % 20:02d}"
            rows.append((f"s{s}", f"S{s}", day, status, n, 1, None, [0, 30, None][s]))
    return rows


def runs_table(spark, rows):
    return spark.createDataFrame(rows, RUNS.replace("run_at date", "run_at string")).withColumn("run_at", F.to_date("run_at"))


def by_hand(rows):
    """The health rule run by run."""
    count, out = {}, {}
    for slug, _, day, status, n, _, _, onboarded in sorted(rows, key=lambda r: r[2]):
        baseline = count.get(slug) or onboarded
        health = "degraded" if status == "ok" and baseline and n < baseline * 0.5 else status
        count[slug] = n if status == "ok" else count.get(slug, 0)
        out[slug, day] = (health, count[slug])
    return out


def test_health_history_agrees_with_the_rule(spark):
    rows = run_rows(1)
    got = health_history(runs_table(spark, rows)).collect()
    assert {(r.slug, str(r.run_at)): (r.health, r["count"]) for r in got} == by_hand(rows)


def test_degraded_run_lowers_the_baseline(spark):
    rows = [("a", "A", f"2024-01-0{i}", "ok", n, 1, None, 100) for i, n in enumerate([60, 49, 20, 11, 10], 1)]
    got = [(r.health, r.baseline) for r in health_history(runs_table(spark, rows)).orderBy("run_at").collect()]
    assert got == [("ok", 100), ("ok", 60), ("degraded", 49), ("ok", 20), ("ok", 11)]


def test_snapshot_and_listing(spark):
    rows = [("a", "A", "2024-01-01", "ok", 8, 2, None, 0), ("a", "A", "2024-02-01", "error", 3, 1, "boom", 0)]
    snapshot = health_snapshot(health_history(runs_table(spark, rows)))
    r = snapshot.first()
    assert (r.status, r["count"], r.last_count, r.pages, r.error, str(r.last_run)) == ("error", 8, 3, 1, "boom", "2024-02-01")
    docs = [('{"slug":"a","popups":[{"candidates":["x"]}],"pagination":{"type":"next"}}',), ('{"slug":"b"}',)]
    sites = with_defaults(spark.createDataFrame(docs, "d string").select(F.from_json("d", SITE_SCHEMA).alias("s")).select("s.*"))
    got = sorted(map(tuple, site_listing(sites, snapshot).collect()))
    assert got == [("a", "next", 1, "error", "3"), ("b", "none", 0, "-", "-")]


def test_site_run_status(spark):
    visits = [("r", "ok", "O", 1, None, None), ("r", "ok", "O", 2, None, None), ("r", "none", "N", 1, None, None),
              ("r", "shut", "B", 1, "HTTP 403", None), ("r", "fail", "F", 1, None, None), ("r", "fail", "F", 2, None, "boom"),
              ("r", "late", "L", 1, None, None), ("r", "late", "L", 2, "HTTP 403", None)]
    jobs = [("r", "ok")] * 3 + [("r", "fail"), ("r", "shut"), ("r", "late")]
    df = spark.createDataFrame(visits, "run_id string, slug string, name string, page_no int, block_reason string, error string")
    runs = site_run_status(df, spark.createDataFrame(jobs, "run_id string, slug string"))
    assert {r.slug: (r.status, r.n_jobs, r.pages, r.error) for r in runs.collect()} == {
        "ok": ("ok", 3, 2, None), "none": ("empty", 0, 1, None), "shut": ("blocked", 0, 0, "HTTP 403"),
        "fail": ("error", 1, 2, "boom"), "late": ("ok", 1, 2, None),
    }
    assert sorted(run_summary(runs).columns) == ["company", "error", "jobs", "pages", "status"]


def test_streamed_health_equals_batch_and_repeats_safely(spark, tmp_path):
    rows = run_rows(2)
    days = sorted({r[2] for r in rows})
    parts = [days[:13], days[13:14], days[14:]]
    for batch_id, part in enumerate(parts):
        batch = runs_table(spark, [r for r in rows if r[2] in part and not (batch_id == 1 and r[0] == "s1")])
        update_health(batch, batch_id, str(tmp_path))
        update_health(batch, batch_id, str(tmp_path))
    seen = [r for r in rows if not (r[2] in parts[1] and r[0] == "s1")]
    got = spark.read.parquet(f"{tmp_path}/history").collect()
    assert {(r.slug, str(r.run_at)): (r.health, r["count"]) for r in got} == by_hand(seen)
    assert len(got) == len(seen)


def test_health_batches_touch_their_sites_only(spark, tmp_path):
    """A batch writes the buckets of its sites, two versions of a bucket stay, and old sites are forgotten when asked."""
    import datetime

    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    make = lambda *rows: spark.createDataFrame(
        [(s, s, day(d), n, "ok", 10) for s, d, n in rows], "slug string, name string, run_at timestamp, n_jobs int, status string, onboarded_job_count int")
    versions = lambda: {p.parent.name: sorted(x.name for x in p.parent.iterdir()) for p in Path(f"{tmp_path}/state").glob("bucket=*/batch_id=*")}
    update_health(make(("a", 0, 10), ("b", 0, 10)), 0, str(tmp_path))
    assert len(versions()) == 2
    for k in range(1, 6):
        update_health(make(("a", k, 10 + k)), k, str(tmp_path))
    both = sorted(versions().values())
    assert both == [["batch_id=0"], ["batch_id=4", "batch_id=5"]]
    update_health(make(("a", 5, 1)), 5, str(tmp_path))  # repeated with other rows: judged against batch 4
    last = spark.read.parquet(f"{tmp_path}/history").filter("batch_id = 5").first()
    assert (last.baseline, last.health) == (14, "degraded")
    update_health(make(("b", 400, 3)), 6, str(tmp_path), buckets=1, expire="30 days")
    update_health(make(("a", 401, 5)), 7, str(tmp_path), buckets=1, expire="30 days")
    kept = spark.read.parquet(f"{tmp_path}/state").filter("batch_id = 7").collect()
    assert {r.slug for r in kept} == {"a", "b"}
