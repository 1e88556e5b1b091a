"""From fetched pages to ranked jobs: the whole run as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.text import block_reason
from cardmill.operators.dom import flatten_dom
from cardmill.operators.extract import CARD_NODE_COLUMNS, extract_cards, extraction_specs, listing_frame
from cardmill.operators.health import site_run_status
from cardmill.operators.jobs import (
    deduplicate,
    harvest_first_seen,
    normalize_jobs,
    pagination_cutoff,
    rank_jobs,
    within_cutoff,
)
from cardmill.operators.selectors import BROADCAST_SPECS, control_specs, has_next, needed, next_control
from cardmill.session import grown, materialize

JOB_ORDER = ["slug", "page_no", "pos"]


@dataclass
class Run:
    """Tables of one run: raw harvested jobs, ranked jobs and a status row per site."""

    raw: DataFrame
    ranked: DataFrame
    runs: DataFrame


def extract_pages(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Raw job rows of pages (page_id, url, html, slug), reading only the elements that selectors can match."""
    specs = extraction_specs(sites)
    nodes = flatten_dom(pages, CARD_NODE_COLUMNS, carry=["page_id", "url", "slug"], **needed(specs))
    return extract_cards(nodes, sites, specs)


def listing_frames(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """The frame of each view that holds the list; pages without frames as they are. Only keys are compared."""
    if not {"view_id", "frame_no", "frame_url"} <= set(pages.columns):
        return pages
    frames = pages.select("page_id", "slug", "view_id", "frame_no", "frame_url")
    frames = frames.join(sites.select("slug", "frame_url_contains"), "slug")
    return pages.join(grown(listing_frame(frames, F.col("frame_url_contains")).select("page_id")), "page_id", "left_semi")


def rank(raw: DataFrame, order: list[str] = JOB_ORDER, min_score: int | None = fixed.MIN_SCORE) -> DataFrame:
    """Normalized rows without duplicates, scored, filtered and sorted."""
    return rank_jobs(deduplicate(normalize_jobs(raw), order), order, min_score)


def scrape(pages: DataFrame, sites: DataFrame, run_id: str, max_pages: int | None = None) -> Run:
    """Run the sites over their fetched pages (page_id, slug, page_no, url, html, status).

    Blocked sites are left out, pages after a run's end are not counted, and rows seen twice in a run
    are kept once. Where pages come as the frames of a view (view_id, frame_no, frame_url), the frame
    that the site's marker names is read. A page that could not be read to its end gives the run the
    status 'error', with the rows found so far.
    """
    sites = materialize(sites)
    by_site = grown if sites.count() > BROADCAST_SPECS else lambda t: t  # tables with a row per site
    sites = by_site(sites)
    pages = listing_frames(pages, sites)
    reason = block_reason(F.col("html"), F.col("status"))
    visits = pages.select("page_id", "slug", "page_no", reason.alias("block_reason")).join(
        sites.select("slug", "name", "pagination"), "slug"
    )
    visits = materialize(visits)
    blocked = visits.filter("page_no = 1 and block_reason is not null").select("slug").distinct()
    open_pages = pages.join(by_site(blocked), "slug", "left_anti")
    controls, fields = control_specs(sites), extraction_specs(sites)
    nodes = materialize(
        flatten_dom(
            open_pages,
            [*CARD_NODE_COLUMNS, "classes", "error"],
            carry=["page_id", "url", "slug", "page_no"],
            **needed(controls, fields),
        )
    )

    jobs = extract_cards(nodes, sites, fields).join(grown(visits.select("page_id", "page_no")), "page_id")
    first_seen = materialize(harvest_first_seen(jobs))
    p = F.col("pagination")
    reachable = p.type.isin("next", "page_number")
    steps = has_next(visits, next_control(nodes, controls), F.when(reachable, p.url_template))
    limit = F.lit(max_pages) if max_pages else p.max_pages
    cutoff = by_site(pagination_cutoff(
        steps, first_seen, max_pages=limit, kind=p.type, can_continue=F.col("can_continue")
    ))
    names = sites.select("slug", F.col("name").alias("company"))
    raw = within_cutoff(first_seen, cutoff).drop("company").join(names, "slug")
    errors = nodes.filter("error is not null").groupBy("page_id").agg(F.min("error").alias("error"))
    read = visits.join(cutoff.select("slug", "pages"), "slug").filter("page_no <= pages").join(grown(errors), "page_id", "left")
    runs = site_run_status(
        read.select(F.lit(run_id).alias("run_id"), "slug", "name", "page_no", "block_reason", "error"),
        raw.select(F.lit(run_id).alias("run_id"), "slug"),
    )
    return Run(raw=normalize_jobs(raw), ranked=rank(raw), runs=runs)
