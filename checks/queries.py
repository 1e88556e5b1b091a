"""One query per operator, over the whole test tables.

The tables are not about jobs, so each query first reads them as the operator's input: ``documents`` as
job rows, ``events`` as responses, visits and runs, ``lineitem`` as harvested rows, ``supplier`` as sites.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardmill.functions import elements, text, urls, verdicts
from cardmill.operators import dom, evaluate, extract, frontier, health, infer, jobs, selectors, weights
from cardmill.plans import onboard, rate, scrape
from cardmill.session import grown, ship_package, work_dir
from cardmill.sources import capture, pages, sheets, sites
from cardmill.streaming import harvest
from cardmill.streaming.health import health_stream

FEED_SITE = {
    "name": "Feed",
    "slug": "feed",
    "start_url": "https://feed.example.com/",
    "dom": {
        "card": {"candidates": ["div.job-card", "li::marker", "nav > ul > li"]},
        "fields": {
            "title": {"selectors": ["h3", "a"]},
            "apply_url": {"selectors": [":scope > a"], "attr": "href"},
            "location": {"selectors": ["body"], "closest": True, "attr": "class"},
            "job_id": {"selectors": [], "attr": "data-id"},
        },
        "apply_url_template": "https://feed.example.com/{job_id}",
    },
    "pagination": {
        "type": "next",
        "control": {"candidates": ["a.pager-next", "nav > ul > li:nth-of-type(6) > a"]},
    },
}
TEXT_WEIGHTS = {r"copyright|license(d)?": 5, r"the": 1, r"nicht|und": 2, r"email|e-mail": -3}
BLOCK_MARKERS = ("cheap-pills", "spam-farm")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def site_table(spark: SparkSession, *docs: dict) -> DataFrame:
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    parsed = rows.select(F.from_json("doc", sites.SITE_SCHEMA).alias("s")).select("s.*")
    return sites.with_defaults(parsed)


def feed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as one site. The sample tables are one file of one row group each, so they are dealt out to all cores here;
    the library never shuffles pages for that."""
    found = pages.read_pages(spark, f"{sf}/pages.parquet").repartition(spark.sparkContext.defaultParallelism)
    return pages.single_site(found, "feed")


def null_text() -> Column:
    return F.lit(None).cast("string")


# --- text and urls ------------------------------------------------------------------------------
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


def absolute_url(spark, sf):
    base = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.absolute_url(F.lit("/a b/ü?x=1#f"), base).alias("rooted"),
        urls.absolute_url(F.lit("../up/./x"), base).alias("up"),
        urls.absolute_url(F.lit("?p=3"), base).alias("query_only"),
        urls.absolute_url(F.lit("//CDN.Example.com:443/q"), base).alias("host_only"),
    )


def clean_text(spark, sf):
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Location: "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        text.clean_text(said).alias("all_lines"),
        text.clean_text(said, single_line=True).alias("first_line"),
    )


def slugify(spark, sf):
    name = F.concat_ws(" & ", F.lit("--"), "c_name", "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", text.slugify(name).alias("slug"))


def is_plausible_query(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.is_plausible_query(F.col("text")).cast("int").alias("plausible")
    )


def block_reason(spark, sf):
    status = F.when(F.col("page_id") % 7 == 0, 403).otherwise(200)
    return table(spark, sf, "pages").select(
        "page_id", text.block_reason(F.col("html"), status, BLOCK_MARKERS).alias("reason")
    )


def fill_template(spark, sf):
    row = F.create_map(
        F.lit("segment"), F.col("c_mktsegment"),
        F.lit("key"), F.col("c_custkey").cast("string"),
        F.lit("name"), F.when(F.col("c_nationkey") == 0, "").otherwise(F.col("c_name")),
    )
    template = F.lit("https://x.example.com/{segment}/{key}?n={name}")
    return table(spark, sf, "customer").select("c_custkey", urls.fill_template(template, row).alias("link"))


def search_url(spark, sf):
    query = F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.concat("s_name", F.lit(" & co*~")))
    results = F.lit("https://x.example.com/jobs?q={query}&l=IN")
    return table(spark, sf, "supplier").select("s_suppkey", urls.search_url(query, results).alias("url"))


def query_url_template(spark, sf):
    lower = F.lower("c_mktsegment")
    url = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://x.example.com/jobs?l=IN&q="), lower, F.lit("#top")))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("https://x.example.com/jobs/"), lower, F.lit("/all")))
        .otherwise(F.lit("https://x.example.com/jobs"))
    )
    query = F.concat(F.lit(" "), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", urls.query_url_template(url, query).alias("template"))


def page_url_template(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.page_url_template(F.regexp_replace(url, "[?#].*$", ""), url).alias("from_query"),
        urls.page_url_template(F.regexp_extract(url, "^[a-z]+://[^/]*/", 0), url).alias("from_root"),
    )


def id_url_template(spark, sf):
    customer = table(spark, sf, "customer")
    key, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    detail = F.concat(F.lit("https://x.example.com/c/"), key, F.lit("?n="), F.lower(segment), F.lit("#top"))
    values = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("class").alias("attr"), name.alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("data-id").alias("attr"), key.alias("value")),
        F.struct(F.lit(2).alias("ord"), F.lit("data-n").alias("attr"), F.lower(F.substring(segment, 1, 5)).alias("value")),
    )
    attributes = customer.select(F.col("c_custkey").alias("page_id"), F.explode(values).alias("a")).select(
        "page_id", "a.*", F.array().cast("array<string>").alias("selectors")
    )
    details = customer.select(F.col("c_custkey").alias("page_id"), detail.alias("detail_url"))
    return frontier.id_url_template(details, attributes).select("page_id", "template", "attr")


# --- sites --------------------------------------------------------------------------------------
def supplier_sites(spark, sf) -> DataFrame:
    """Suppliers as site configs."""
    key = F.col("s_suppkey")
    kinds = F.array(*[F.lit(k) for k in ("none", "next", "page_number", "load_more", "scroll")])
    doc = F.struct(
        F.col("s_name").alias("name"),
        text.slugify(F.col("s_name")).alias("slug"),
        F.concat(F.lit("https://s"), key, F.lit(".example.com/jobs")).alias("start_url"),
        F.struct(
            F.struct(F.array(F.lit("li")).alias("candidates")).alias("card"),
            F.struct(F.struct(F.array(F.lit("a")).alias("selectors")).alias("title")).alias("fields"),
        ).alias("dom"),
        F.when(key % 3 == 0, F.struct(F.concat(F.lit("team "), "s_nationkey").alias("query"),
               F.concat(F.lit("https://s"), key, F.lit(".example.com/s?q={query}")).alias("results_url"))).alias("search"),
        F.struct(
            F.when(key % 11 == 0, "sideways").otherwise(F.get(kinds, (key % 5).cast("int"))).alias("type"),
            F.when(key % 2 == 0, F.concat(F.lit("https://s"), key, F.lit(".example.com/jobs?page={page}")))
            .otherwise(F.concat(F.lit("https://s"), key, F.lit(".example.com/jobs?start={offset}"))).alias("url_template"),
            F.when(key % 4 != 0, (key % 7 + 1).cast("int")).alias("max_pages"),
        ).alias("pagination"),
        F.transform(
            F.array_repeat(F.lit("x"), (key % 3).cast("int")), lambda _: F.struct(F.array(F.lit("b")).alias("candidates"))
        ).alias("popups"),
    )
    return table(spark, sf, "supplier").select("s_suppkey", doc.alias("doc"))


def written_sites(spark, sf) -> str:
    """Write one JSON document per supplier, as a folder of site configs.

    The rows are dealt out to all cores, as the sample table is one row group, and each task moves its files into the fresh
    folder itself, where else the driver would move all, one after the other."""
    path = work_dir(spark)
    docs = supplier_sites(spark, sf).select("doc.*").repartition(spark.sparkContext.defaultParallelism)
    docs.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)
    return path


def read_site_configs(spark, sf):
    return sites.read_site_configs(spark, written_sites(spark, sf)).select(
        "slug", "schema_version", F.col("pagination.max_pages").alias("max_pages"),
        F.col("search.submit").alias("submit"), "onboarded_job_count",
    )


def rejected_site_configs(spark, sf):
    found = sites.scan_site_configs(spark, written_sites(spark, sf)).filter(F.col("reject_reason").isNotNull())
    return found.select("slug", "reject_reason")


def filter_sites(spark, sf):
    stems = supplier_sites(spark, sf).select(F.col("doc.slug").alias("stem"), "s_suppkey")
    return sites.filter_sites(stems, ["Supplier 000000007", "SUPPLIER#000000042!", "nobody"])


def upsert_site_configs(spark, sf):
    rows = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("slug"), F.col("s_suppkey").cast("string").alias("start_url")
    )
    old = table(spark, sf, "nation").filter("n_regionkey < 3").select(
        F.col("n_nationkey").alias("slug"), F.col("n_name").alias("start_url")
    )
    new = rows.groupBy("slug").agg(F.max("start_url").alias("start_url"))
    merged, refused = sites.upsert_site_configs(old, new)
    replaced, _ = sites.upsert_site_configs(old, new, force=True)
    return (
        merged.withColumn("part", F.lit("merged"))
        .unionByName(refused.withColumn("part", F.lit("refused")))
        .unionByName(replaced.withColumn("part", F.lit("replaced")))
    )


def page_frontier(spark, sf):
    configs = sites.read_site_configs(spark, written_sites(spark, sf))
    return frontier.page_frontier(configs)


def site_listing(spark, sf):
    key = F.col("s_suppkey")
    configs = supplier_sites(spark, sf).select(key.alias("slug"), "doc.pagination", "doc.popups")
    snapshot = health.health_snapshot(health.health_history(event_runs(spark, sf)))
    return health.site_listing(configs, snapshot)


# --- job rows -----------------------------------------------------------------------------------
def document_jobs(spark, sf) -> DataFrame:
    """Documents as raw job rows."""
    key = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat("lang", F.lit(" Inc")).alias("company"),
        F.col("text").alias("title"),
        F.concat(F.lit("Location: "), "source").alias("location"),
        F.concat(F.lit("Team"), F.lit("\n"), "lang", F.lit("\n"), "lang").alias("department"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Posted on: day "), key)).alias("posted"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Job ID: "), key)).alias("job_id"),
        F.when(F.col("doc_id") % 4 < 2, F.concat(F.lit("https://x.example.com/"), key, F.lit("/?utm_source=a&k=1#f"))).alias("apply_url"),
        F.create_map(F.lit("blank"), F.lit(""), F.lit("chars"), F.col("n_chars").cast("string")).alias("extras"),
    )


def normalize_jobs(spark, sf):
    cleaned = jobs.normalize_jobs(document_jobs(spark, sf))
    return cleaned.withColumn("extras", F.array_join(F.map_keys("extras"), ","))


def deduplicate(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), F.col("lang").alias("company"), F.col("text").alias("title"), "source"
    )
    return jobs.deduplicate(rows).select("ord", "company", "source")


def keyword_score(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", jobs.keyword_points(F.col("text"), TEXT_WEIGHTS).alias("score")
    )


def keyword_table(spark, sf):
    """The same points, with the patterns as a table."""
    ship_package(spark)
    weighted = spark.createDataFrame(list(TEXT_WEIGHTS.items()), "pattern string, points int")
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return weights.keyword_points_of(rows, "text", weighted, "score").select("doc_id", F.col("score").cast("int").alias("score"))


def rank_jobs(spark, sf):
    roles = F.array(*[F.lit(r) for r in ("Software Engineer", "Senior Back-end Developer", "SRE", "Sales Head", "Intern, SWE")])
    places = F.array(*[F.lit(p) for p in ("Pune, India", "Remote", "Berlin", "Remote - India")])
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.concat_ws(" ", F.get(roles, (F.col("c_custkey") % 5).cast("int")), "c_mktsegment").alias("title"),
        F.get(places, (F.col("c_nationkey") % 4).cast("int")).alias("location"),
    )
    return jobs.rank_jobs(rows, min_score=5)


def ranked_documents(spark, sf):
    """Normalize, deduplicate, score, filter and rank in one plan."""
    return scrape.rank(document_jobs(spark, sf), ["ord"], min_score=None).select("ord", "company", "job_id", "apply_url", "score")


def preview(spark, sf):
    return jobs.preview(document_jobs(spark, sf), 8).select("company", "ord", "location", "job_id")


def union_results(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("location"))
    return jobs.union_results(orders, items)


def harvested_items(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("slug"),
        F.col("l_linenumber").alias("page_no"),
        F.col("l_orderkey").alias("pos"),
        F.col("l_partkey").cast("string").alias("job_id"),
    )


def harvest_first_seen(spark, sf):
    return jobs.harvest_first_seen(harvested_items(spark, sf)).select("slug", "job_key", "page_no", "pos")


def event_pages(spark, sf) -> DataFrame:
    """Events as harvested rows: the days a user was active are the pages."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    days = events.select("user_id", "day").distinct().withColumn("page_no", number)
    return events.join(days, ["user_id", "day"]).select(
        "user_id",
        "page_no",
        F.col("event_id").alias("pos"),
        F.concat_ws("|", "event_type", (F.floor("value") % 4).cast("string")).alias("job_id"),
    )


def pagination_cutoff(spark, sf):
    rows = event_pages(spark, sf)
    seen = jobs.harvest_first_seen(rows, ["user_id"])
    fetched = rows.select("user_id", "page_no").distinct()
    return jobs.pagination_cutoff(fetched, seen, ["user_id"], max_pages=F.lit(12)).select("user_id", "pages", "n_jobs")


def new_listing_keys(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("title"), F.col("o_orderpriority").alias("apply_url"), "o_orderkey"
    )
    return jobs.new_listing_keys(orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1"))


# --- runs and health ----------------------------------------------------------------------------
def event_runs(spark, sf) -> DataFrame:
    """Events as site runs: a user's day is a run, a day with an error event fails."""
    runs = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("slug"), F.to_date("ts").alias("run_at"))
        .agg(
            F.count("*").cast("int").alias("n_jobs"),
            F.max(F.when(F.col("event_type") == "error", "error")).alias("status"),
            F.countDistinct("event_type").cast("int").alias("pages"),
        )
    )
    return runs.withColumns(
        {
            "status": F.coalesce("status", F.lit("ok")),
            "name": F.concat(F.lit("user "), "slug"),
            "onboarded_job_count": (F.col("slug") % 9).cast("int"),
            "error": F.when(F.col("status").isNotNull(), "failed"),
        }
    )


def health_history(spark, sf):
    week = F.date_trunc("week", F.col("run_at"))
    history = health.health_history(event_runs(spark, sf), bucket=week)
    return history.select("slug", F.col("run_at").cast("string").alias("run_at"), "n_jobs", "baseline", "health", "count")


def health_snapshot(spark, sf):
    snapshot = health.health_snapshot(health.health_history(event_runs(spark, sf)))
    return snapshot.withColumn("last_run", F.col("last_run").cast("string"))


def run_status(spark, sf) -> DataFrame:
    run = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id")
    events = table(spark, sf, "events").withColumn("page_no", F.row_number().over(run))
    kind = F.col("event_type")
    visits = events.select(
        F.to_date("ts").cast("string").alias("run_id"),
        F.col("user_id").alias("slug"),
        F.concat(F.lit("user "), "user_id").alias("name"),
        "page_no",
        F.when(kind == "signup", "HTTP 403").alias("block_reason"),
        F.when(kind == "error", F.concat(F.lit("failed "), "event_id")).alias("error"),
    )
    harvested = events.filter(kind.isin("click", "purchase")).select(
        F.to_date("ts").cast("string").alias("run_id"), F.col("user_id").alias("slug")
    )
    return health.site_run_status(visits, harvested)


def site_run_status(spark, sf):
    return run_status(spark, sf)


def run_summary(spark, sf):
    return health.run_summary(run_status(spark, sf))


# --- model verdicts -----------------------------------------------------------------------------
def event_replies(spark, sf) -> DataFrame:
    """Events with the model reply they stand for."""
    k = F.get_json_object("props", "$.k")
    reply = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('Sure: {"fit": " yES ", "score": "'), k, F.lit('/100", "reason": "fits"} ok')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"fit": "maybe",\n "score": -'), k, F.lit(', "reason": "may\\"be"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"reason": "x", "score": "none", "fit": "No"}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"fit": "No", "score": 1, "reason": '), k, F.lit("}")))
        .otherwise(F.lit("no answer"))
    )
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", reply.alias("reply"))


def parse_verdict(spark, sf):
    verdict = event_replies(spark, sf).select("event_id", verdicts.parse_verdict(F.col("reply")).alias("v"))
    return verdict.select("event_id", "v.fit", "v.score", "v.reason")


def build_prompt(spark, sf):
    job = [F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")), null_text()]
    return table(spark, sf, "customer").select("c_custkey", verdicts.build_prompt(*job).alias("prompt"))


def evaluate_jobs(spark, sf):
    ship_package(spark)

    def scorer(prompts):
        """Rate by the company named in the prompt; some replies are unusable on purpose."""
        replies = []
        for prompt in prompts:
            company = prompt.split("Company: ")[1].split("\n")[0]
            replies.append(None if company == "error" else f'{{"fit": "maybe", "score": {len(company)}, "reason": "{company}"}}')
        return replies

    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.col("event_type").alias("company"), F.col("props").alias("title"),
        (F.col("user_id") % 10).cast("int").alias("score"),
    )
    return evaluate.evaluate_jobs(rows, scorer, limit=4000).drop("title")


def ai_rank(spark, sf):
    rows = event_replies(spark, sf).select(
        F.col("event_id").alias("ord"), verdicts.parse_verdict(F.col("reply")).score.alias("ai_score"),
        (F.col("user_id") % 10).cast("int").alias("score"),
    )
    return jobs.ai_rank(rows)


# --- capture log and sheets ---------------------------------------------------------------------
def event_responses(spark, sf) -> DataFrame:
    """Events as recorded responses."""
    types = {"click": "xhr", "view": "document", "purchase": "script", "signup": "image", "error": "fetch"}
    contents = {
        "click": "application/json; charset=utf-8", "view": "text/html", "purchase": "application/javascript",
        "signup": "image/png", "error": "text/plain",
    }

    def lookup(m: dict) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("event_type"))

    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"),
        F.concat(F.lit("https://h.example.com/"), "event_type", F.lit("?u="), "user_id").alias("url"),
        F.when(F.col("user_id") % 6 == 0, 302).otherwise(200).alias("status"),
        lookup(types).alias("resource_type"),
        lookup(contents).alias("content_type"),
        (F.floor("value") * 100000).cast("bigint").alias("body_bytes"),
        F.create_map(F.lit("x-user"), F.col("user_id").cast("string")).alias("request_headers"),
        F.concat(F.lit("https://h.example.com/"), "user_id").alias("frame_url"),
    )


def capture_body_plan(spark, sf):
    responses = event_responses(spark, sf)
    both = [capture.capture_body_plan(responses, m).withColumn("mode", F.lit(m)) for m in ("all", "data")]
    return both[0].unionByName(both[1]).select(
        "id", "mode", "ext", F.col("wants_body").cast("int").alias("wants_body"), "body_file", "body_skipped"
    )


def read_capture_index(spark, sf):
    path = work_dir(spark)
    event_responses(spark, sf).withColumn("ts", F.col("ts") / 1e6).write.json(path)
    index = capture.read_capture_index(spark, path)
    return index.select(
        "id", "url", "status", F.date_trunc("second", "at").cast("string").alias("at"),
        F.try_element_at("request_headers", F.lit("x-user")).alias("user"),
    )


def visited_url_templates(spark, sf):
    visits = table(spark, sf, "events").select(
        F.col("user_id").alias("visit_id"), F.col("event_id").alias("ts"),
        F.concat(F.lit("https://h.example.com/jobs?t="), "event_type", F.lit("&page="), F.floor("value").cast("int") % 4).alias("url"),
    )
    return capture.visited_url_templates(visits).select("visit_id", "ts", "url_template")


def listing_frame(spark, sf):
    frames = event_responses(spark, sf).select(
        F.col("frame_url").alias("view_id"), F.col("id").alias("frame_no"), F.col("url").alias("frame_url")
    )
    return extract.listing_frame(frames, F.lit("/purchase"))


def export_projection(spark, sf):
    return sheets.export_projection(sheet_jobs(spark, sf))


def sheet_jobs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("A\x07"), "text").alias("title"),
        F.array("lang", "source").alias("department"),
        null_text().alias("location"),
        F.col("n_chars").alias("score"),
        F.col("doc_id").cast("string").alias("job_id"),
        F.lit("x").alias("custom"),
    )


def job_sheet_round_trip(spark, sf):
    path = work_dir(spark)
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("job_id"), F.concat("p_name", F.lit('\n"'), "p_type", F.lit('",')).alias("title"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("location"),
    )
    sheets.write_job_sheet(parts, path)
    return sheets.read_job_sheet(spark, path)


def write_run(spark, sf):
    raw = document_jobs(spark, sf)
    path = work_dir(spark)
    sheets.write_run(raw, path, "r1", "jobs_raw")
    sheets.write_run(jobs.deduplicate(raw), path, "r1", "jobs_ranked")
    return spark.read.parquet(path).select("run_id", "stage", "ord", "company", "job_id", "apply_url")


def rate_sheet(spark, sf):
    """A sheet of customers, written, read, rated in the order of its scores and read back."""
    ship_package(spark)

    def scorer(prompts):
        titles = [p.split("Title: ")[1].split("\n")[0] for p in prompts]
        return [f'{{"fit": "Maybe", "score": {len(t) % 10}, "reason": "{t}"}}' for t in titles]

    source, target = work_dir(spark), work_dir(spark)
    listed = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), F.concat_ws(" ", "c_mktsegment", "c_custkey").alias("title"), (F.col("c_nationkey") % 10).alias("score")
    )
    sheets.write_job_sheet(listed, source)
    return rate.rate_sheet(spark, source, target, scorer).select("job_id", "title", "score", "ai_fit", "ai_score", "ai_reason")


def ordered_union(spark, sf):
    """Results of three sites, each in its own order, as one list."""
    some = lambda name, key, text: table(spark, sf, name).select(F.lit(name).alias("company"), F.col(key).cast("long").alias("id"), F.col(text).alias("title"))
    return jobs.union_results(some("supplier", "s_suppkey", "s_name"), some("customer", "c_custkey", "c_mktsegment"), some("nation", "n_nationkey", "n_name"), order=[F.col("title").desc(), "id"])


def ranked_positions(spark, sf):
    """The places of scored rows in their order."""
    placed = rank_jobs(spark, sf).withColumn("_m", F.monotonically_increasing_id())
    return jobs.numbered(placed, ["_m"], "place").select("ord", "score", "place")


def rated_positions(spark, sf):
    """The places of rated rows in their order."""
    placed = ai_rank(spark, sf).withColumn("_m", F.monotonically_increasing_id())
    return jobs.numbered(placed, ["_m"], "place").select("ord", "place")


# --- pages --------------------------------------------------------------------------------------
def flatten_dom(spark, sf):
    ship_package(spark)
    nodes = dom.flatten_dom(feed_pages(spark, sf), ["tag"])
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def visible_text(spark, sf):
    ship_package(spark)
    nodes = dom.flatten_dom(feed_pages(spark, sf), ["tag", "text"])
    heads = nodes.filter(F.col("tag").isin("h1", "footer"))
    return heads.select("page_id", "tag", dom.visible_text(F.col("text")).alias("text"))


def page_nodes(spark, sf, columns, attrs=()):
    ship_package(spark)
    return dom.flatten_dom(feed_pages(spark, sf), columns, attrs, carry=["page_id", "url", "slug", "page_no"])


def match_selectors(spark, sf):
    nodes = page_nodes(spark, sf, [*selectors.MATCH_COLUMNS, "text"], ["href"])
    wanted = ["nav > ul > li", "nav li:nth-of-type(2) > a", "div.ad", "article b", "a[href]", "div > a", '[href="/The"]',
              'a:text-is("The")']
    specs = spark.createDataFrame([("feed", i, s) for i, s in enumerate(wanted)], "slug string, rank int, selector string")
    hits = selectors.match_selectors(nodes, selectors.Specs.of(specs))
    return hits.groupBy("page_id", "rank").agg(F.count("*").alias("n"))


def extract_cards(spark, sf):
    ship_package(spark)
    rows = scrape.extract_pages(feed_pages(spark, sf), site_table(spark, FEED_SITE))
    order = Window.partitionBy("page_id").orderBy("pos")
    return rows.select("page_id", F.row_number().over(order).alias("card_no"), "title", "apply_url", "job_id")


def count_cards(spark, sf):
    nodes = page_nodes(spark, sf, selectors.MATCH_COLUMNS)
    return extract.count_cards(nodes, site_table(spark, FEED_SITE), feed_pages(spark, sf))


def next_control(spark, sf):
    nodes = page_nodes(spark, sf, [*selectors.MATCH_COLUMNS, "visible", "classes", "attrs"])
    specs = selectors.control_specs(site_table(spark, FEED_SITE))
    return selectors.next_control(nodes, specs).select("page_id")


def selector_report(spark, sf):
    nodes = page_nodes(spark, sf, [*selectors.MATCH_COLUMNS, "visible", "classes", "attrs"])
    specs = selectors.control_specs(site_table(spark, FEED_SITE))
    return selectors.selector_report(nodes, feed_pages(spark, sf).drop("html"), specs)


def classify_pagination(spark, sf):
    nodes = page_nodes(spark, sf, ["node_id", "tag", "text", "attrs", "classes"]).filter("tag = 'a'")
    template = elements.page_number_template(F.col("text"), elements.element_signature(F.col("tag"), F.col("classes"), F.col("attrs")))
    kind = elements.classify_pagination(F.col("text"), F.col("attrs"), template)
    return nodes.groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def text_category(spark, sf):
    flags = elements.text_category(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[flags[f].cast("int").alias(f) for f in ("location", "posted", "department")])


def scrape_pages(spark, sf):
    """The whole run: pages to ranked listing rows."""
    ship_package(spark)
    rows = scrape.extract_pages(feed_pages(spark, sf), site_table(spark, FEED_SITE))
    ranked = scrape.rank(rows.withColumn("company", F.lit("Feed")), ["page_id", "pos"], min_score=None)
    return ranked.select("page_id", "title", "apply_url", "score")


def site_run(spark, sf):
    """A run with paging: every host is a site, its pages in page_id order are the listing pages."""
    ship_package(spark)
    fetched = pages.read_pages(spark, f"{sf}/pages.parquet").withColumn("slug", F.regexp_extract("url", "://([^/]*)", 1))
    number = Window.partitionBy("slug").orderBy("page_id")
    fetched = fetched.withColumns({"page_no": F.row_number().over(number), "status": F.lit(200)})
    parsed = F.from_json(F.lit(json.dumps(FEED_SITE)), sites.SITE_SCHEMA).alias("s")
    hosts = fetched.select(F.col("slug").alias("host")).distinct().select("host", parsed).select("host", "s.*")
    configs = sites.with_defaults(hosts.withColumns({"slug": F.col("host"), "name": F.col("host")}).drop("host"))
    run = scrape.scrape(fetched, configs, "r1")
    return run.runs


def site_run_states(spark, sf):
    """The same run, with pages as views of two frames of which the second holds the list, and sites whose first page is blocked."""
    ship_package(spark)
    fetched = pages.read_pages(spark, f"{sf}/pages.parquet").withColumn("slug", F.regexp_extract("url", "://([^/]*)", 1))
    number = Window.partitionBy("slug").orderBy("page_id")
    fetched = fetched.withColumn("page_no", F.row_number().over(number)).withColumn("status", F.when((F.col("page_no") == 1) & (F.col("page_id") % 3 == 0), 403).otherwise(200))
    frames = fetched.withColumn("view_id", F.col("page_id")).withColumn("frame_no", F.explode(F.array(F.lit(0), F.lit(1))))
    frames = frames.withColumns({
        "page_id": F.col("page_id") * 2 + F.col("frame_no"), "frame_url": F.when(F.col("frame_no") == 1, "https://h/embedded-list").otherwise(F.col("url")),
        "html": F.when(F.col("frame_no") == 1, F.col("html")).otherwise("<html><body><iframe></iframe></body></html>"),
    })
    parsed = F.from_json(F.lit(json.dumps(FEED_SITE | {"frame_url_contains": "embedded-list"})), sites.SITE_SCHEMA).alias("s")
    hosts = fetched.select(F.col("slug").alias("host")).distinct().select("host", parsed).select("host", "s.*")
    configs = sites.with_defaults(hosts.withColumns({"slug": F.col("host"), "name": F.col("host")}).drop("host"))
    return scrape.scrape(frames, configs, "r1").runs


# --- learning configs ---------------------------------------------------------------------------
def element_signature(spark, sf):
    nodes = page_nodes(spark, sf, ["tag", "classes", "attrs"])
    sig = elements.element_signature(F.col("tag"), F.col("classes"), F.col("attrs"))
    return nodes.groupBy("page_id", sig.alias("sig")).agg(F.count("*").alias("n"))


def shared_signatures(spark, sf):
    ship_package(spark)
    nodes = infer.prepare_nodes(feed_pages(spark, sf))
    return infer.shared_signatures(nodes).groupBy("page_id", "shared_sig").agg(F.count("*").alias("n"))


def path_selectors(spark, sf):
    ship_package(spark)
    nodes = infer.prepare_nodes(feed_pages(spark, sf))
    navs = nodes.filter("tag = 'nav'").select("page_id", F.col("node_id").alias("card_id"))
    links = nodes.filter("tag = 'a'").select("page_id", F.col("node_id").alias("leaf_id"))
    return infer.path_selectors(nodes, navs.join(links, "page_id")).select("page_id", "path_key")


def infer_configs(spark, sf):
    ship_package(spark)
    learned = infer.infer_configs(feed_pages(spark, sf))
    field = lambda name: F.array_join(F.try_element_at("fields", F.lit(name)).selectors, " | ")
    return learned.select(
        "page_id", "count", F.array_join("candidates", " | ").alias("candidates"),
        field("title").alias("title"), field("apply_url").alias("apply_url"),
    )


def customer_pages(spark, sf, linked: bool = True) -> DataFrame:
    """Customers as listing pages of ten cards each, as HTML."""
    key = F.col("c_custkey")
    places = F.array(*[F.lit(p) for p in ("Pune, India", "Remote", "Berlin, Germany")])
    title = F.concat(F.lit("<a class='name' href='/c/"), key, F.lit("'>"), "c_name", F.lit("</a>")) if linked else F.concat(
        F.lit("<h3 class='name'>"), "c_name", F.lit("</h3>"))
    card = F.concat(
        F.lit("<li class='card' data-job-id='c-"), key, F.lit("'>"), title, F.lit("<div><span>"),
        F.get(places, (F.col("c_nationkey") % 3).cast("int")), F.lit("</span><span>"), "c_mktsegment",
        F.lit("</span><span>"), F.col("c_nationkey") % 9 + 1, F.lit(" days ago</span></div></li>"),
    )
    slug = F.floor(key / 10)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), card.alias("c")))), lambda x: x.c), "\n")
    listed = table(spark, sf, "customer").groupBy(slug.alias("page_id")).agg(body.alias("cards"))
    slug = F.concat(F.lit("s"), "page_id")
    return listed.select(
        "page_id", slug.alias("slug"), slug.alias("name"), F.lit(1).alias("page_no"),
        F.concat(F.lit("https://s"), "page_id", F.lit(".example.com/jobs")).alias("url"),
        F.concat(F.lit("<html><body><h1>Jobs</h1><ul class='list'>"), "cards", F.lit("</ul></body></html>")).alias("html"),
    )


def learn_sites(spark, sf):
    """Learn a config for every listing page, then read the pages with it."""
    ship_package(spark)
    fetched = customer_pages(spark, sf)
    configs = onboard.learn_sites(fetched)
    rows = scrape.extract_pages(fetched, configs)
    return rows.select("slug", "title", "location", "department", "posted", "job_id", "apply_url")


def learn_and_run(spark, sf):
    """Learn sites with their paging from first pages, write and read the configs, and run them over all pages."""
    ship_package(spark)
    fetched = customer_pages(spark, sf).withColumns({"page_no": (F.col("page_id") % 2 + 1).cast("int"), "slug": F.concat(F.lit("s"), F.floor(F.col("page_id") / 2))})
    address = F.concat(F.lit("https://"), "slug", F.lit(".example.com/jobs"))
    onward = F.when(F.col("page_no") == 1, "<a class='onward' href='?page=2'>Further</a>").otherwise("<a class='onward disabled'>Further</a>")
    fetched = fetched.withColumns({
        "name": F.col("slug"), "status": F.lit(200), "url": F.when(F.col("page_no") == 1, address).otherwise(F.concat(address, F.lit("?page=2"))),
        "html": F.replace(F.col("html"), F.lit("</ul>"), F.concat(F.lit("</ul><p>"), onward, F.lit("</p>"))),
    })
    one = fetched.filter("page_no = 1")
    used = infer.prepare_nodes(one).filter("text = 'Further' and tag = 'a'")
    used = used.join(grown(one.select("page_id", F.concat("url", F.lit("?page=2")).alias("after_url"))), "page_id").select("page_id", "node_id", "after_url")
    folder = work_dir(spark)
    sites.write_site_configs(onboard.learn_sites(one, controls=used), folder)
    run = scrape.scrape(fetched, sites.read_site_configs(spark, folder, lines=True), "r1")
    return run.runs.select("slug", "status", "n_jobs", "pages")


def learn_link_templates(spark, sf):
    """Cards without links: the address of one opened card gives the link of all."""
    ship_package(spark)
    fetched = customer_pages(spark, sf, linked=False)
    nodes = infer.prepare_nodes(fetched)
    targets = nodes.filter("tag = 'h3'").groupBy("page_id").agg(F.min("node_id").alias("node_id")).withColumn("target_id", F.col("node_id"))
    opened = F.concat(F.lit("https://x.example.com/job?id=c-"), F.col("page_id") * 10, F.lit("&v=1#top"))
    configs = onboard.learn_sites(fetched, targets, fetched.select("page_id", opened.alias("detail_url")))
    rows = scrape.extract_pages(fetched, configs)
    return rows.select("slug", "title", "job_id", "apply_url")


def verify_sites(spark, sf):
    ship_package(spark)
    fetched = customer_pages(spark, sf)
    return onboard.verify_sites(fetched, onboard.learn_sites(fetched)).select("slug", "onboarded_job_count")


def control_kinds(spark, sf):
    """Controls of suppliers that turn the page by number, add rows or lead on."""
    key = F.col("s_suppkey")
    shown = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, "Load  more").otherwise("Further")
    template = F.when(key % 2 == 0, 'a:text-is("{page}")')
    kind = elements.classify_pagination(shown, F.create_map(F.lit("rel"), F.lit("x")), template)
    return table(spark, sf, "supplier").select("s_suppkey", kind.alias("kind"))


def shared_names(spark, sf):
    """Lists of customers in which a name that few items have is no part of the shared signature, but one of most is."""
    ship_package(spark)
    k = F.col("c_custkey")
    item = F.concat(
        F.lit("<li class='item"), F.when(k % 5 == 0, " chief").otherwise(""), F.when(k % 10 < 8, " plain").otherwise(""), F.lit("'>"), "c_name", F.lit("</li>"))
    listed = table(spark, sf, "customer").groupBy(F.floor(k / 50).alias("page_id")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    nodes = infer.prepare_nodes(listed.select("page_id", F.concat(F.lit("<ul>"), "items", F.lit("</ul>")).alias("html")))
    found = infer.shared_signatures(nodes).filter("shared_sig like 'li%'")
    return found.groupBy("page_id", "shared_sig").agg(F.count("*").alias("n"))


def control_disabled(spark, sf):
    """Controls of suppliers, switched off in each of the ways that count."""
    key = F.col("s_suppkey") % 8
    classes = F.split(F.when(key == 0, "step is-disabled").when(key == 1, "disabled").when(key == 2, "undisabledly").otherwise("step"), " ")
    attrs = (
        F.when(key == 3, F.create_map(F.lit("disabled"), F.lit(""))).when(key == 4, F.create_map(F.lit("aria-disabled"), F.lit("true")))
        .when(key == 5, F.create_map(F.lit("aria-disabled"), F.lit("false"))).when(key == 6, F.create_map(F.lit("style"), F.lit("Pointer-Events : none")))
        .otherwise(F.create_map(F.lit("rel"), F.lit("next")))
    )
    return table(spark, sf, "supplier").select("s_suppkey", elements.control_disabled(classes, attrs).cast("int").alias("disabled"))


def hidden_cards(spark, sf):
    """Listing pages on which cards are hidden by an attribute, a style of their own or a rule of the page."""
    ship_package(spark)
    how = F.expr("CASE k % 7 WHEN 0 THEN ' hidden' WHEN 1 THEN ' style=\"display: none\"' WHEN 2 THEN ' class=\"off\"' ELSE '' END")
    card = F.concat(F.lit("<li"), how, F.lit("><a href='/c/"), "k", F.lit("'>"), "c_name", F.lit("</a></li>"))
    rows = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    listed = rows.groupBy(F.floor(F.col("k") / 20).alias("page_id")).agg(F.array_join(F.collect_list(card), "").alias("cards"))
    site = {"name": "C", "slug": "c", "start_url": "https://c.test/", "dom": {"card": {"candidates": ["ul > li"]}, "fields": {"title": {"selectors": ["a"]}}}}
    html = F.concat(F.lit("<html><head><style>.off{display:none}</style></head><body><ul>"), "cards", F.lit("</ul></body></html>"))
    fetched = listed.select("page_id", F.lit("https://c.test/").alias("url"), html.alias("html"), F.lit("c").alias("slug"), F.lit(1).alias("page_no"))
    return scrape.extract_pages(fetched, site_table(spark, site)).select("page_id", "title")


def infer_field(spark, sf):
    """The field spec that follows from one chosen element of a card: the second text of the first card of each page."""
    ship_package(spark)
    nodes = infer.prepare_nodes(customer_pages(spark, sf))
    targets = nodes.filter("tag = 'a'").groupBy("page_id").agg(F.min("node_id").alias("node_id")).withColumn("target_id", F.lit(0))
    _, members = infer.infer_cards(nodes, targets)
    picks = nodes.filter("tag = 'span' and nth_of_type = 2").groupBy("page_id").agg(F.min("node_id").alias("node_id"))
    found = infer.infer_field(nodes, members, picks.select("page_id", F.lit(0).alias("target_id"), F.lit("department").alias("field"), "node_id"))
    return found.select("page_id", "field", F.array_join("selectors", " | ").alias("selectors"))


# --- streams ------------------------------------------------------------------------------------
def stream_harvest(spark, sf):
    """Rows arriving in several batches, kept once each."""
    source, folder = work_dir(spark), work_dir(spark)
    rows = harvested_items(spark, sf)
    rows.repartition(4, "slug", "job_id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    harvest.harvest_stream(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("slug", "job_key", "page_no", "pos")


def stream_pages(spark, sf):
    """Pages arriving in several batches, extracted and kept once per job."""
    ship_package(spark)
    source, folder = work_dir(spark), work_dir(spark)
    fetched = feed_pages(spark, sf)
    each = spark.sparkContext.defaultParallelism  # files of a batch, so that all cores write and read pages
    fetched.repartition(2 * each, "page_id").write.parquet(source)
    stream = spark.readStream.schema(fetched.schema).option("maxFilesPerTrigger", each).parquet(source)
    extract_rows = harvest.page_extractor(site_table(spark, FEED_SITE))
    run = harvest.harvest_stream(stream, f"{folder}/rows", f"{folder}/checkpoint", extract_rows, order=["page_id", "pos"])
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("slug", "job_key")


def stream_first_seen(spark, sf):
    """Repeats dropped inside a watermark, with bounded state."""
    source, folder = work_dir(spark), work_dir(spark)
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema("user_id long, event_type string, ts timestamp").parquet(source)
    seen = harvest.first_seen_within(stream, ["user_id", "event_type"], "ts", "60 days")
    run = seen.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("user_id", "event_type")


def stream_health(spark, sf):
    """Finished runs arriving in three parts, judged against the counts carried from part to part."""
    source, folder = work_dir(spark), work_dir(spark)
    runs = event_runs(spark, sf)
    for first, last in (("2000-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2100-01-01")):
        runs.filter(F.col("run_at").between(first, last)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(runs.schema).parquet(source)
        health_stream(stream, folder, f"{folder}/checkpoint").awaitTermination()
    history = spark.read.parquet(f"{folder}/history")
    return history.select("slug", F.col("run_at").cast("string").alias("run_at"), "n_jobs", "baseline", "health", "count")


FUNCTIONS = [
    canonical_url, absolute_url, clean_text, slugify, is_plausible_query, block_reason, fill_template, search_url,
    query_url_template, page_url_template, id_url_template, read_site_configs, rejected_site_configs, filter_sites,
    upsert_site_configs, page_frontier, site_listing, normalize_jobs, deduplicate, keyword_score, keyword_table, rank_jobs,
    ranked_documents, preview, union_results, harvest_first_seen, pagination_cutoff, new_listing_keys, health_history,
    health_snapshot, site_run_status, run_summary, parse_verdict, build_prompt, evaluate_jobs, ai_rank,
    capture_body_plan, read_capture_index, visited_url_templates, listing_frame, export_projection,
    job_sheet_round_trip, write_run, flatten_dom, visible_text, match_selectors, extract_cards, count_cards,
    next_control, selector_report, classify_pagination, text_category, scrape_pages, site_run,
    rate_sheet, ordered_union, ranked_positions, rated_positions, site_run_states,
    element_signature, shared_signatures, path_selectors, infer_configs, learn_sites, learn_link_templates, verify_sites, control_kinds, shared_names, control_disabled, hidden_cards, infer_field, learn_and_run,
    stream_harvest, stream_pages, stream_first_seen, stream_health,
]
QUERIES = {f.__name__: f for f in FUNCTIONS}
