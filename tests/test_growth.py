"""Joins of tables that grow with the input send no side to the driver, however small their files are."""

import pytest
from pyspark.sql import functions as F

from cardmill.operators import extract, infer, selectors
from cardmill.operators.dom import flatten_dom
from cardmill.plans import onboard, scrape
from cardmill.session import BATCH_BYTES, grown, materialize, size_in_bytes
from cardmill.sources import sites as site_source
from cardmill.streaming import harvest
from checks import queries
from pages_html import listing


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"s{k}", f"Site {k}", f"https://l.com/{k}", listing(1, 1, total=6)) for k in range(1, 5)]
    return materialize(spark.createDataFrame(rows, "page_id long, slug string, name string, url string, html string"))


@pytest.fixture(scope="module")
def learned(pages):
    nodes = infer.prepare_nodes(pages)
    cards, members = infer.infer_cards(nodes, materialize(infer.default_targets(nodes)))
    return nodes, cards, members


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_learning_broadcasts_nothing(learned):
    nodes, cards, members = learned
    links = nodes.filter("tag = 'a'").select("page_id", F.lit(0).alias("card_id"), F.col("node_id").alias("leaf_id"))
    tables = [
        infer.shared_signatures(nodes), infer.path_selectors(nodes, links), infer.infer_title_link(nodes, cards), infer.infer_fields(nodes, cards, members),
        infer.infer_id_attribute(nodes, cards, members), infer.card_attributes(nodes, cards),
    ]
    for df in tables:
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_selectors_of_many_sites_are_not_broadcast(spark, pages, monkeypatch):
    sites = onboard.learn_sites(pages)
    few = scrape.extract_pages(pages, sites)
    want = {tuple(map(str, r)) for r in few.select("page_id", "title", "apply_url").collect()}
    monkeypatch.setattr(selectors, "BROADCAST_SPECS", 3)
    specs = extract.extraction_specs(sites)
    assert specs.large
    nodes = flatten_dom(pages, extract.CARD_NODE_COLUMNS, carry=["page_id", "url", "slug"], **selectors.needed(specs))
    rows = extract.extract_cards(nodes, sites, specs)
    assert "Broadcast" not in plan(rows) and "Broadcast" not in plan(selectors.match_selectors(nodes, specs))
    assert {tuple(map(str, r)) for r in rows.select("page_id", "title", "apply_url").collect()} == want and len(want) == 24
    assert onboard.verify_sites(pages, sites).filter("onboarded_job_count = 6").count() == 4


def test_grown_is_a_side_of_one_join(spark):
    a = spark.range(5)
    assert "SortMergeJoin" in plan(a.join(grown(a), "id"))
    assert a.join(grown(a), "id").count() == 5


def test_folder_of_configs_is_written_by_many_tasks_and_opened_once(spark):
    folder = queries.written_sites(spark, "/root/testdata/sf0.001")
    files = spark.read.json(folder, multiLine=True).select(F.col("_metadata.file_name").alias("f"))
    parts = files.select(F.split("f", "-")[1].alias("part"), "f").agg(F.countDistinct("part"), F.countDistinct("f")).first()
    assert parts[0] > 1 and parts[1] == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    read = site_source.read_site_configs(spark, folder)
    assert "hashpartitioning(stem" in plan(read)  # what the sort samples and reads
    stems = [r.stem for r in read.select("stem").collect()]
    assert stems == sorted(stems) and len(stems) > 1


def test_pages_reach_the_parser_in_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 100_000), F.lit("</p>")).alias("html"))
    found = flatten_dom(pages.coalesce(1), ["tag"])
    assert size_in_bytes(spark.conf.get(name)) <= BATCH_BYTES
    assert found.count() == 300


def test_arriving_pages_meet_their_rows_by_merge(spark, pages):
    site = queries.FEED_SITE | {"slug": "s1", "dom": {"card": {"candidates": ["section.opening"]}, "fields": {"title": {"selectors": ["a"]}}}}
    rows = harvest.page_extractor(queries.site_table(spark, site))(pages.withColumn("page_no", F.lit(1)))
    joins = [x for x in plan(rows).splitlines() if "Join" in x]
    assert "SortMergeJoin [page_id" in joins[0]
