"""Fetched pages, the input of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (page_id, url, html, …) from Parquet."""
    return spark.read.parquet(path)


def single_site(pages: DataFrame, slug: str, page_no: int = 1) -> DataFrame:
    """Pages that all belong to one site run."""
    return pages.withColumns({"slug": F.lit(slug), "page_no": F.lit(page_no)})
