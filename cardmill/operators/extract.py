"""Cards and their fields: from element rows and site configs to raw job rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.urls import absolute_url, fill_template
from cardmill.operators.inside import inside
from cardmill.operators.selectors import MATCH_COLUMNS, Specs, first_candidates, in_scope, match_selectors
from cardmill.session import grown, materialize

# Node columns that extraction reads.
CARD_NODE_COLUMNS = [*MATCH_COLUMNS, "attrs", "text", "visible", "link", "inner_link", "base_href"]


def card_specs(sites: DataFrame) -> DataFrame:
    """Card candidates (slug, rank, selector)."""
    return sites.select("slug", F.posexplode("dom.card.candidates").alias("rank", "selector"))


def field_specs(sites: DataFrame) -> DataFrame:
    """Field selectors (slug, field, attr, closest, rank, selector).

    A field without selectors has one row with a null selector: it reads the card itself.
    """
    fields = sites.select("slug", F.explode("dom.fields").alias("field", "spec"))
    return fields.select(
        "slug",
        "field",
        F.col("spec.attr").alias("attr"),
        F.coalesce("spec.closest", F.lit(False)).alias("closest"),
        F.posexplode_outer("spec.selectors").alias("rank", "selector"),
    )


def extraction_specs(sites: DataFrame) -> Specs:
    """All compiled selectors of the sites, with the ``kind`` of use: card, self, inner or closest.

    A field that reads the card itself becomes a 'self' row per card candidate.
    """
    cards, fields = card_specs(sites), field_specs(sites)
    direct = fields.filter(F.col("selector").isNull()).select("slug", "field", "attr")
    wanted = (
        cards.withColumn("kind", F.lit("card"))
        .unionByName(cards.join(grown(direct), "slug").withColumn("kind", F.lit("self")), allowMissingColumns=True)
        .unionByName(
            fields.filter(F.col("selector").isNotNull())
            .withColumn("kind", F.when(F.col("closest"), "closest").otherwise("inner"))
            .drop("closest"),
            allowMissingColumns=True,
        )
    )
    return Specs.of(wanted)


def count_cards(nodes: DataFrame, sites: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Matched cards per page; pages without a match count 0 when ``pages`` is given."""
    counts = (
        match_selectors(nodes, Specs.of(card_specs(sites)))
        .groupBy("page_id", "rank")
        .agg(F.count("*").alias("n"))
        .groupBy("page_id")
        .agg(F.min(F.struct("rank", "n")).n.alias("n_cards"))
    )
    if pages is None:
        return counts
    return pages.select("page_id").join(grown(counts), "page_id", "left").fillna(0, ["n_cards"])


def read_value(attr: Column) -> Column:
    """Raw value of an element: its link, an attribute, or its text."""
    own = F.try_element_at("attrs", F.lit("href"))
    return (
        F.when(attr == "href", F.coalesce(own, F.col("link"), F.col("inner_link")))
        .when(attr.isNotNull(), F.try_element_at(F.col("attrs"), attr))
        .otherwise(F.col("text"))
    )


def extract_cards(nodes: DataFrame, sites: DataFrame, specs: Specs | None = None) -> DataFrame:
    """Raw job rows: page_id, slug, pos (card id), the eight job fields and ``extras``.

    For each card and field the first selector that matches inside the card wins, then the first
    element in the document; ``closest`` looks upwards instead. A matched element without a value does
    not fall through to the next selector. Rows without a title are dropped.

    One pass over the elements keeps the matched ones, which are written to the work folder. Only they
    are shuffled, on (page_id, card id), so a page with very many elements spreads over many tasks.
    """
    specs = specs or extraction_specs(sites)
    value = F.when(F.col("kind") != "card", read_value(F.col("attr")))
    matches = materialize(
        match_selectors(nodes, specs).select(
            "page_id", "slug", "url", "base_href", "kind", "field", "attr", "rank", "node_id", "subtree_end", "depth", "visible",
            value.alias("value"),
            "scoped", "scope_near", "tops",
        )
    )
    cards = first_candidates(matches.filter("kind = 'card'")).filter("visible")
    card_keys = cards.select(
        "page_id", F.col("node_id").alias("card_id"), F.col("subtree_end").alias("card_end"), F.col("depth").alias("card_depth")
    )
    found = ["page_id", "card_id", "slug", "field", "attr", "rank", "at", "value", "url", "base_href"]

    hits = (
        inside(card_keys, matches.filter("kind = 'inner'"), "node_id", "card_id", "card_end")
        .filter(in_scope(F.col("card_id"), F.col("card_depth")))
        .withColumn("at", F.col("node_id"))
        .select(*found)
    )
    if specs.may_have("closest"):
        around = matches.filter("kind = 'closest' and not scoped")
        above = inside(around, card_keys.select("page_id", "card_id"), "card_id", "node_id", "subtree_end", own=True)
        hits = hits.unionByName(above.withColumn("at", -F.col("node_id")).select(*found))
    if specs.may_have("self"):
        itself = matches.filter("kind = 'self'").join(grown(cards.select("page_id", "node_id", "rank")), ["page_id", "node_id", "rank"])
        hits = hits.unionByName(itself.withColumns({"card_id": F.col("node_id"), "at": F.lit(0)}).select(*found))

    first = F.min(F.struct("rank", "at", "value", "attr", "url", "base_href")).alias("first")
    picked = (
        hits.groupBy("page_id", "card_id", "slug", "field")
        .agg(first)
        .select("page_id", "card_id", "slug", "field", "first.*")
    )
    own_base = absolute_url(F.col("base_href"), F.col("url"))
    final = F.when(F.col("attr") == "href", absolute_url(F.col("value"), F.col("base"))).otherwise(F.col("value"))
    rows = (
        picked.filter(F.coalesce("value", F.lit("")) != "")
        .withColumn("base", F.when(F.col("base_href").isNull(), F.col("url")).otherwise(own_base))
        .groupBy("page_id", "card_id", "slug")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", final.alias("value")))).alias("row"))
    )
    return _job_columns(apply_url_fallback(rows, grown(sites) if specs.large else sites))


def _job_columns(rows: DataFrame) -> DataFrame:
    known = [F.try_element_at("row", F.lit(f)).alias(f) for f in fixed.JOB_FIELDS]
    extras = F.map_filter("row", lambda k, v: ~k.isin(fixed.JOB_FIELDS)).alias("extras")
    jobs = rows.select("page_id", "slug", F.col("card_id").alias("pos"), *known, extras, "_link")
    return jobs.filter(F.col("title").isNotNull()).withColumn("apply_url", F.coalesce("apply_url", "_link")).drop("_link")


def apply_url_fallback(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Add ``_link``, the site's link template filled from the ``row`` map, for rows without their own link."""
    templates = sites.select("slug", F.col("dom.apply_url_template").alias("_template"))
    return (
        rows.join(templates, "slug", "left")
        .withColumn("_link", fill_template(F.col("_template"), F.col("row")))
        .drop("_template")
    )


def listing_frame(frames: DataFrame, marker: Column, view: str = "view_id", order: str = "frame_no") -> DataFrame:
    """The document that holds the list: first frame whose url contains the marker, else the main frame.

    ``frames`` has one row per document of a page view; the main frame comes first in ``order``.
    """
    found = F.coalesce((marker != "") & F.contains(F.col("frame_url"), marker), F.lit(False))
    w = Window.partitionBy(view).orderBy(F.col("_found").desc(), order)
    return (
        frames.withColumn("_found", found)
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn", "_found")
    )
