"""Learning site configs from pages, and checking them by replaying them on the same pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.functions.elements import classify_pagination, page_number_template
from cardmill.functions.text import is_plausible_query
from cardmill.functions.urls import page_url_template, query_url_template
from cardmill.operators.frontier import id_url_template
from cardmill.operators.infer import (
    KEY,
    card_attributes,
    default_targets,
    infer_cards,
    infer_fields,
    path_selectors,
    prepare_nodes,
)
from cardmill.operators.jobs import harvest_first_seen
from cardmill.plans.scrape import extract_pages
from cardmill.session import grown, materialize
from cardmill.sources.sites import SITE_SCHEMA, with_defaults


def learn_paging(nodes: DataFrame, pages: DataFrame, controls: DataFrame) -> DataFrame:
    """(page_id, pagination): how the used control of each page is found again, what it does and which urls it leads to.

    ``controls`` has page_id, node_id and after_url, the address after its use. The exact path comes first, as the other
    selectors may also hit controls beside it.
    """
    used = controls.join(grown(nodes.select("page_id", "node_id", "parent_id", "tag", "text", "attrs", "sig")), ["page_id", "node_id"])
    parents = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("sig").alias("parent_sig"))
    roots = nodes.filter(F.col("parent_id").isNull()).groupBy("page_id").agg(F.min(F.struct("node_id", "sig")).alias("root"))
    pairs = used.join(grown(roots), "page_id").select("page_id", F.col("root.node_id").alias("card_id"), F.col("node_id").alias("leaf_id"))
    paths = path_selectors(nodes, pairs).select("page_id", F.col("leaf_id").alias("node_id"), "path_key")
    found = used.join(grown(parents), ["page_id", "parent_id"]).join(grown(roots), "page_id").join(grown(paths), ["page_id", "node_id"])
    found = found.join(grown(pages.select("page_id", "url")), "page_id")
    template = page_number_template(F.col("text"), F.col("sig"))
    exact = F.concat("root.sig", F.expr("substring(path_key, 7)"))  # from the page's root instead of ':scope'
    candidates = F.array_distinct(F.array(exact, F.concat("parent_sig", F.lit(" > "), "sig"), F.col("sig")))
    return found.select(
        "page_id",
        F.struct(
            classify_pagination(F.col("text"), F.col("attrs"), template).alias("type"),
            F.struct(candidates.alias("candidates")).alias("control"),
            template.alias("page_number_template"),
            page_url_template(F.col("url"), F.col("after_url")).alias("url_template"),
        ).alias("pagination"),
    )


def learn_searches(searches: DataFrame) -> DataFrame:
    """(page_id, search): the saved query and the url of its results, from (page_id, query, results_url)."""
    usable = searches.filter(is_plausible_query(F.col("query")))
    results = query_url_template(F.col("results_url"), F.col("query"))
    return usable.select("page_id", F.struct("query", results.alias("results_url")).alias("search"))


def learn_sites(
    pages: DataFrame,
    targets: DataFrame | None = None,
    details: DataFrame | None = None,
    controls: DataFrame | None = None,
    searches: DataFrame | None = None,
) -> DataFrame:
    """One config per site, learned from its listing page (page_id, url, html, slug, name).

    ``targets`` (page_id, target_id, node_id) says which element is a job title; without it each repeated
    link position is tried and the largest group of cards wins. Of several pages of a site the one with the
    largest group is learned from, of equal ones the one with the smallest page_id. ``details`` (page_id, detail_url) gives
    the address that opened for a card, from which a link template is made when cards have no link.
    ``controls`` and ``searches`` (see ``learn_paging`` and ``learn_searches``) give paging and search.
    """
    nodes = prepare_nodes(pages)
    targets = materialize(default_targets(nodes) if targets is None else targets)
    cards, members = infer_cards(nodes, targets)
    best = cards.groupBy("page_id").agg(F.max(F.struct("count", -F.col("target_id"))).alias("b"))
    best = best.select("page_id", (-F.col("b.col2")).alias("target_id"))
    sized = cards.join(grown(best), KEY).join(grown(pages.select("page_id", "slug")), "page_id")
    best = sized.groupBy("slug").agg(F.max(F.struct("count", -F.col("page_id"), "target_id")).alias("b"))
    best = materialize(best.select((-F.col("b.col2")).alias("page_id"), "b.target_id"))
    cards = materialize(cards.join(grown(best), KEY))
    members = members.join(grown(best), KEY)
    fields = infer_fields(nodes, cards, members)
    learned = cards.join(grown(fields), KEY).select("page_id", "candidates", "fields")
    learned = _link_templates(learned, card_attributes(nodes, cards), details)
    dom = F.struct(
        F.struct(F.col("candidates")).alias("card"), F.col("fields"), F.col("template").alias("apply_url_template")
    )
    rows = pages.select("page_id", "slug", "name", F.col("url").alias("start_url")).join(grown(learned), "page_id")
    parts = ["slug", "name", "start_url", "dom"]
    rows = rows.withColumn("dom", dom)
    if controls is not None:
        rows = rows.join(grown(learn_paging(nodes, pages, controls)), "page_id", "left")
        parts.append("pagination")
    if searches is not None:
        rows = rows.join(grown(learn_searches(searches)), "page_id", "left")
        parts.append("search")
    rows = rows.select(F.to_json(F.struct(*parts)).alias("doc"))
    return materialize(with_defaults(rows.select(F.from_json("doc", SITE_SCHEMA).alias("s")).select("s.*")))


def _link_templates(learned: DataFrame, attributes: DataFrame, details: DataFrame | None) -> DataFrame:
    """Add ``template`` and the matching job_id field for cards without a link."""
    if details is None:
        return learned.withColumn("template", F.lit(None).cast("string"))
    made = id_url_template(details, attributes).select(
        "page_id",
        "template",
        F.struct(F.col("selectors"), F.col("attr"), F.lit(False).alias("closest")).alias("id_spec"),
    )
    joined = learned.join(grown(made), "page_id", "left")
    needs = ~F.map_contains_key("fields", "apply_url") & F.col("template").isNotNull()
    others = F.map_filter("fields", lambda k, _: k != "job_id")
    filled = F.map_concat(others, F.create_map(F.lit("job_id"), F.col("id_spec")))
    return joined.select(
        "page_id",
        "candidates",
        F.when(needs, filled).otherwise(F.col("fields")).alias("fields"),
        F.when(needs, F.col("template")).alias("template"),
    )


def verify_sites(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """The configs with ``onboarded_job_count`` set to the different rows that a run of them reads from the pages."""
    rows = extract_pages(pages, sites)
    number = pages.select("page_id", "page_no") if "page_no" in pages.columns else pages.select("page_id", F.lit(1).alias("page_no"))
    seen = harvest_first_seen(rows.join(grown(number), "page_id"))
    counts = seen.groupBy("slug").agg(F.count("*").cast("int").alias("_n"))
    return sites.join(grown(counts), "slug", "left").withColumn("onboarded_job_count", F.coalesce("_n", F.lit(0))).drop("_n")
