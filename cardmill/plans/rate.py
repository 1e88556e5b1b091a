"""Rating jobs with a model: those of a run, or an exported sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.operators.evaluate import Scorer, evaluate_jobs
from cardmill.session import materialize
from cardmill.sources.sheets import read_job_sheet, write_job_sheet


def _numbered(jobs: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with ``ord`` rising in the given order, written once so that the numbers stay the same."""
    return materialize(jobs.orderBy(*order).withColumn("ord", F.monotonically_increasing_id()))


def rate_ranked(ranked: DataFrame, scorer: Scorer | None, limit: int | None = None) -> DataFrame:
    """Rate the first ``limit`` rows of a run's ranked jobs; all rows come back, best rated first."""
    if scorer is None:
        return ranked
    numbered = _numbered(ranked, F.col("score").desc(), "slug", "page_no", "pos")
    return evaluate_jobs(numbered, scorer, limit).drop("ord")


def rate_sheet(spark: SparkSession, path: str, target: str, scorer: Scorer | None, limit: int | None = None) -> DataFrame:
    """Read a sheet, rate its rows in the order of their score and write the rated sheet.

    A sheet written by several tasks has no row order of its own, so equal scores are ordered by content.
    """
    jobs = read_job_sheet(spark, path)
    score = F.col("score").cast("int") if "score" in jobs.columns else F.lit(0)
    rest = [c for c in jobs.columns if c != "score"]
    numbered = _numbered(jobs.withColumn("score", score), F.col("score").desc_nulls_last(), *rest)
    rated = evaluate_jobs(numbered, scorer, limit).drop("ord")
    write_job_sheet(rated, target)
    return read_job_sheet(spark, target)
