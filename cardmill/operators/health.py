"""Site runs over time: run status, degraded runs, the latest state and the site list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill import fixed


TIE = ("status", "n_jobs")  # of runs at one time


def site_run_status(visits: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per (run_id, slug): name, status, n_jobs, pages, error.

    ``visits`` has a row per opened page (run_id, slug, name, page_no, block_reason, error), ``jobs`` a
    row per harvested job (run_id, slug). A run blocked on its first page reads no page and no job; a
    failed run keeps the jobs it had. Jobs are counted before the shuffle.
    """
    seen = visits.select("run_id", "slug", "name", "page_no", "block_reason", "error", F.lit(0).alias("_job"))
    found = jobs.select("run_id", "slug", F.lit(1).alias("_job"))
    totals = (
        seen.unionByName(found, allowMissingColumns=True)
        .groupBy("run_id", "slug")
        .agg(
            F.max("name").alias("name"),
            F.sum("_job").alias("n"),
            F.max("page_no").alias("last_page"),
            F.max(F.when(F.col("page_no") == 1, F.col("block_reason"))).alias("blocked"),
            F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_no"))).alias("failure"),
        )
    )
    blocked = F.col("blocked").isNotNull()
    return totals.select(
        "run_id",
        "slug",
        "name",
        F.when(blocked, "blocked")
        .when(F.col("failure").isNotNull(), "error")
        .when(F.col("n") > 0, "ok")
        .otherwise("empty")
        .alias("status"),
        F.when(blocked, 0).otherwise(F.col("n")).cast("int").alias("n_jobs"),
        F.when(blocked, 0).otherwise(F.coalesce("last_page", F.lit(0))).cast("int").alias("pages"),
        F.coalesce("blocked", "failure").alias("error"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """What a run prints: company, status, pages, jobs and error."""
    return runs.select(
        F.col("name").alias("company"), "status", "pages", F.col("n_jobs").alias("jobs"), "error"
    )


def health_history(runs: DataFrame, order: str = "run_at", bucket: Column | None = None) -> DataFrame:
    """Add ``health`` and the stored ``count`` to every run, with the baseline it is compared with.

    The baseline is the count of the last 'ok' run if it is not 0, else ``onboarded_job_count``. An 'ok'
    run below half of it is 'degraded'; its count still becomes the next baseline.

    The carried count is found in two levels, within time buckets (months by default) and across them,
    so that a site with very many runs spreads over many tasks.
    """
    bucket = F.date_trunc("month", F.col(order)) if bucket is None else bucket
    ok_jobs = F.when(F.col("status") == "ok", F.col("n_jobs"))
    runs = runs.withColumn("_bucket", bucket)
    before = (Window.unboundedPreceding, -1)
    across = Window.partitionBy("slug").orderBy("_bucket").rowsBetween(*before)
    within = Window.partitionBy("slug", "_bucket").orderBy(order, *TIE).rowsBetween(*before)
    carried = (
        runs.groupBy("slug", "_bucket")
        .agg(F.max_by(ok_jobs, F.when(ok_jobs.isNotNull(), F.struct(order, *TIE))).alias("_last"))
        .select("slug", "_bucket", F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    )
    previous = F.coalesce(F.last(ok_jobs, ignorenulls=True).over(within), F.col("_carried"))
    degraded = (F.col("status") == "ok") & (F.col("n_jobs") < fixed.DEGRADED_SHARE * F.col("baseline"))
    return (
        runs.join(carried, ["slug", "_bucket"])
        .withColumn("_previous", previous)
        .withColumn("baseline", F.coalesce(F.nullif("_previous", F.lit(0)), "onboarded_job_count"))
        .withColumn("health", F.when(F.coalesce(degraded, F.lit(False)), "degraded").otherwise(F.col("status")))
        .withColumn("count", F.coalesce(ok_jobs, "_previous", F.lit(0)))
        .drop("_bucket", "_previous", "_carried")
    )


def health_snapshot(history: DataFrame, order: str = "run_at") -> DataFrame:
    """The latest state of each site: name, last_run, status, count, last_count, pages, error."""
    state = F.struct(
        "name",
        F.col(order).alias("last_run"),
        F.col("health").alias("status"),
        "count",
        F.col("n_jobs").alias("last_count"),
        "pages",
        "error",
    )
    return history.groupBy("slug").agg(F.max_by(state, F.struct(order, *TIE)).alias("s")).select("slug", "s.*")


def site_listing(sites: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Sites with paging type, number of popups, last status and last job count; '-' where never run."""
    last = snapshot.select("slug", F.col("status").alias("last_status"), F.col("last_count").cast("string").alias("last_jobs"))
    return sites.join(last, "slug", "left").select(
        "slug",
        F.col("pagination.type").alias("pagination"),
        F.size("popups").alias("popups"),
        F.coalesce("last_status", F.lit("-")).alias("last_status"),
        F.coalesce("last_jobs", F.lit("-")).alias("last_jobs"),
    )
