"""Listing URLs to fetch, and link templates learned from opened jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.functions.text import strip
from cardmill.functions.urls import search_url, url_tokens, without_fragment
from cardmill.session import grown


def page_frontier(sites: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(slug, page_no, url) of every listing page known in advance.

    Page 1 is the search results page if the search lives in the URL, else the start page. Later pages
    come from a url pattern with '{page}' on 'next' and 'page_number' listings; '{offset}' patterns are
    not replayed.
    """
    p, s = F.col("pagination"), F.col("search")
    first = F.coalesce(search_url(s.query, s.results_url), F.col("start_url"))
    templated = p.type.isin("next", "page_number") & F.contains(p.url_template, F.lit("{page}"))
    limit = F.lit(max_pages) if max_pages else p.max_pages
    last = F.when(F.coalesce(templated, F.lit(False)), F.greatest(limit, F.lit(1))).otherwise(1)
    later = F.replace(p.url_template, F.lit("{page}"), F.col("page_no").cast("string"))
    return sites.select(
        "slug", first.alias("_first"), "pagination", F.explode(F.sequence(F.lit(1), last)).alias("page_no")
    ).select("slug", "page_no", F.when(F.col("page_no") == 1, F.col("_first")).otherwise(later).alias("url"))


def id_url_template(details: DataFrame, attributes: DataFrame) -> DataFrame:
    """(page_id, template, selectors, attr): the card attribute whose value occurs in the opened job's URL.

    ``details`` has (page_id, detail_url), ``attributes`` (page_id, ord, selectors, attr, value). Longer
    values are tried first. A value counts when it equals a decoded path segment or parameter, or, from
    five characters on, occurs anywhere after the host. Its first occurrence in the whole URL, host
    included, becomes '{job_id}'.
    """
    urls = details.select("page_id", without_fragment(F.col("detail_url")).alias("_url")).withColumns(
        {"_tokens": url_tokens(F.col("_url")), "_tail": F.regexp_replace("_url", r"(?s)^(.*?://)?([^/]*/)?", "")}
    )
    candidates = attributes.withColumns(
        {"_value": strip(F.col("value")), "_length": F.length("value")}
    ).filter((F.length("_value") >= 3) & ~F.col("attr").isin("href", "class", "style"))
    within = (F.length("_value") >= 5) & F.contains(F.col("_tail"), F.col("_value"))
    hits = candidates.join(grown(urls), "page_id").filter(F.array_contains("_tokens", F.col("_value")) | within)
    opened = F.overlay("_url", F.lit("{job_id}"), F.instr(F.col("_url"), F.col("_value")), F.length("_value"))
    best = hits.groupBy("page_id").agg(
        F.min(F.struct((-F.col("_length")).alias("l"), "ord", opened.alias("template"), "selectors", "attr")).alias("b")
    )
    return best.select("page_id", "b.template", "b.selectors", "b.attr")
