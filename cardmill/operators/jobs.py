"""Job rows: normalizing, duplicate removal, harvesting order, scoring and ranking.

Every keep-first rule takes an explicit ordinal column, because a DataFrame has no row order.
``row_number() = 1`` compiles to a group limit that runs before the shuffle, so a key that holds a
large share of the rows sends one row per input partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.text import clean_text
from cardmill.functions.urls import canonical_url
from cardmill.session import materialize

ONE_LINE = ("title", "posted", "employment_type", "job_id")
MANY_LINES = ("company", "location", "department")


def normalize_jobs(jobs: DataFrame) -> DataFrame:
    """Clean the eight job fields that are present; ``extras`` keeps its non-empty entries unchanged."""
    cleaned = {c: clean_text(F.col(c), single_line=c in ONE_LINE) for c in ONE_LINE + MANY_LINES}
    cleaned["apply_url"] = F.nullif(canonical_url(F.col("apply_url")), F.lit(""))
    cleaned["extras"] = F.map_filter("extras", lambda k, v: F.coalesce(v, F.lit("")) != "")
    return jobs.withColumns({c: e for c, e in cleaned.items() if c in jobs.columns})


def _text(c: str, df: DataFrame) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def dedupe_key(company: Column, job_id: Column, apply_url: Column, title: Column, location: Column) -> Column:
    """Identity of a job: id within the company, else link, else company, title and place.

    A row known by its id never meets the same job known by its link.
    """
    owner = F.lower(F.coalesce(company, F.lit("")))
    return (
        F.when(job_id != "", F.concat(owner, F.lit("|id|"), job_id))
        .when(apply_url != "", F.concat(F.lit("url|"), F.lower(apply_url)))
        .when(
            title != "",
            F.concat(owner, F.lit("|"), F.lower(title), F.lit("|"), F.lower(F.coalesce(location, F.lit("")))),
        )
    )


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def deduplicate(jobs: DataFrame, order: Sequence[str | Column] = ("ord",)) -> DataFrame:
    """Keep the first row per ``dedupe_key``; rows without a key are dropped."""
    key = dedupe_key(*[_text(c, jobs) for c in ("company", "job_id", "apply_url", "title", "location")])
    keyed = jobs.withColumn("_key", key).filter(F.col("_key").isNotNull())
    return keep_first(keyed, ["_key"], order).drop("_key")


def harvest_key(apply_url: Column, job_id: Column, title: Column, location: Column) -> Column:
    """Identity of a row within one site run: link, else id, else title and place."""
    return (
        F.when(apply_url != "", apply_url)
        .when(job_id != "", F.concat(F.lit("id:"), job_id))
        .when(title != "", F.concat(title, F.lit("|"), F.coalesce(location, F.lit(""))))
    )


def harvest_first_seen(
    rows: DataFrame, site: Sequence[str] = ("slug",), order: Sequence[str | Column] = ("page_no", "pos")
) -> DataFrame:
    """Rows first seen in each site run, in page order; adds ``job_key``."""
    key = harvest_key(*[_text(c, rows) for c in ("apply_url", "job_id", "title", "location")])
    keyed = rows.withColumn("job_key", key).filter(F.col("job_key").isNotNull())
    return keep_first(keyed, [*site, "job_key"], order)


def pagination_cutoff(
    pages: DataFrame,
    first_seen: DataFrame,
    site: Sequence[str] = ("slug",),
    max_pages: Column | None = None,
    kind: Column | None = None,
    can_continue: Column | None = None,
) -> DataFrame:
    """Last page each site run reads and the jobs it gives: one row (site, pages, n_jobs) per site.

    ``pages`` has one row per fetched page (site, page_no). A run stops at the first page after page 1
    with no new job, at ``max_pages``, at page 1 for 'none' and 'scroll' listings, or at a page from
    which it cannot go on. Jobs on later pages are not counted.
    """
    site = list(site)
    stop = F.lit(False)
    if max_pages is not None:
        stop = stop | (F.col("page_no") >= max_pages)
    if kind is not None:
        stop = stop | kind.isin("none", "scroll")
    if can_continue is not None:
        stop = stop | ~F.coalesce(can_continue, F.lit(False))
    grid = pages.select(*site, "page_no", F.lit(0).alias("_new"), stop.alias("_stop"))
    news = first_seen.select(*site, "page_no", F.lit(1).alias("_new"), F.lit(False).alias("_stop"))
    per_page = (
        grid.unionByName(news)
        .groupBy(*site, "page_no")
        .agg(F.sum("_new").alias("_new"), F.max("_stop").alias("_stop"))
        .withColumn("_stop", F.col("_stop") | ((F.col("page_no") > 1) & (F.col("_new") == 0)))
    )
    ends = per_page.groupBy(*site).agg(
        F.coalesce(F.min(F.when(F.col("_stop"), F.col("page_no"))), F.max("page_no")).alias("pages")
    )
    return (
        per_page.join(ends, site)
        .filter(F.col("page_no") <= F.col("pages"))
        .groupBy(*site, "pages")
        .agg(F.sum("_new").alias("n_jobs"))
    )


def within_cutoff(first_seen: DataFrame, cutoff: DataFrame, site: Sequence[str] = ("slug",)) -> DataFrame:
    """First-seen rows on the pages a run really read."""
    return first_seen.join(cutoff.select(*site, "pages"), list(site)).filter("page_no <= pages").drop("pages")


def new_listing_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct (title, apply_url) pairs in ``after`` that are not in ``before``; nulls compare equal."""
    key = ["title", "apply_url"]
    return after.select(*key).subtract(before.select(*key))


def preview(jobs: DataFrame, n: int = 8, site: str = "company", order: Sequence[str | Column] = ("ord",)) -> DataFrame:
    """The first ``n`` rows of each company, normalized."""
    w = Window.partitionBy(site).orderBy(*order)
    first = jobs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return normalize_jobs(first)


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Add each row's position (from 0) in a global order, without a single task: rows are sorted in ranges, and a range's
    rows are counted from where the ranges before it end. Equal rows get positions of their own."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = ranged.withColumn("_part", part).join(counts, "_part").withColumn(name, F.col("_before") + place)
    return found.drop("_at", "_part", "_before")


def union_results(first: DataFrame, *more: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
    """All rows of several company results; columns missing on one side become null.

    With ``order``, the order of rows within a result, a column ``ord`` numbers all rows: results in the order given, each
    after the one before it.
    """
    if order is None:
        for df in more:
            first = first.unionByName(df, allowMissingColumns=True)
        return first
    out, offset = None, 0
    for df in (first, *more):
        rows = materialize(numbered(df, order, "_ord"))
        mine = rows.drop("ord").withColumn("ord", F.col("_ord") + F.lit(offset)).drop("_ord")
        offset += rows.count()
        out = mine if out is None else out.unionByName(mine, allowMissingColumns=True)
    return out


# --- scoring ------------------------------------------------------------------------------------
def keyword_points(text: Column, weights: Mapping[str, int]) -> Column:
    """Sum of the points of every pattern found as whole words; each pattern counts once."""
    text = F.coalesce(text, F.lit(""))
    total = F.lit(0)
    for pattern, points in weights.items():
        total = total + F.when(F.rlike(text, F.lit(rf"(?iU)\b(?:{pattern})\b")), points).otherwise(0)
    return total


def score_job(
    title: Column,
    location: Column,
    title_weights: Mapping[str, int] = fixed.TITLE_KEYWORDS,
    location_weights: Mapping[str, int] = fixed.LOCATION_KEYWORDS,
) -> Column:
    return keyword_points(title, title_weights) + keyword_points(location, location_weights)


def rank_jobs(jobs: DataFrame, order: Sequence[str | Column] = ("ord",), min_score: int | None = None) -> DataFrame:
    """Score the rows, optionally keep those reaching ``min_score``, and sort best first, ties in input order."""
    scored = jobs.withColumn("score", score_job(_text("title", jobs), _text("location", jobs)))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    return scored.orderBy(F.col("score").desc(), *order)


def ai_rank(jobs: DataFrame, order: Sequence[str | Column] = ("ord",)) -> DataFrame:
    """Sort by model score, then keyword score, best first; missing scores count as 0."""
    zero = F.lit(0)
    score = F.coalesce(F.col("score"), zero) if "score" in jobs.columns else zero
    return jobs.orderBy(F.coalesce("ai_score", zero).desc(), score.desc(), *order)
