"""The log of recorded HTTP responses, one JSON line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions.urls import page_url_template

CAPTURE_SCHEMA = """
    id BIGINT, ts DOUBLE, url STRING, method STRING, status INT, resource_type STRING, content_type STRING,
    request_headers MAP<STRING, STRING>, response_headers MAP<STRING, STRING>, post_data STRING, frame_url STRING,
    body_bytes BIGINT, body_file STRING, body_error STRING, body_skipped STRING
"""


def read_capture_index(spark: SparkSession, path: str) -> DataFrame:
    """Responses with their time as a timestamp in ``at``."""
    return spark.read.schema(CAPTURE_SCHEMA).json(path).withColumn("at", F.timestamp_seconds("ts"))


def body_extension(content_type: Column) -> Column:
    """File extension for a body; the first needle found in the content type decides."""
    content_type = F.coalesce(content_type, F.lit(""))
    hits = [F.when(F.contains(content_type, F.lit(n)), F.lit(e)) for n, e in fixed.BODY_EXTENSIONS.items()]
    return F.coalesce(*hits, F.lit(".bin"))


def capture_body_plan(responses: DataFrame, mode: str = "all") -> DataFrame:
    """Add ``ext``, ``wants_body``, ``body_file`` and ``body_skipped``: which bodies are kept, and where.

    Needs id, status, resource_type, content_type and body_bytes (null when no body could be read).
    """
    wants = ~F.col("resource_type").isin(fixed.BODY_SKIP_TYPES) & ~F.col("status").between(300, 399)
    if mode != "all":
        wants &= F.col("resource_type").isin(fixed.BODY_DATA_TYPES)
    ext = body_extension(F.col("content_type"))
    has_body = wants & F.col("body_bytes").isNotNull()
    fits = F.col("body_bytes") <= fixed.BODY_MAX_BYTES
    number = F.col("id").cast("string")
    name = F.concat(F.lit("bodies/"), F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit("0")), ext)
    return responses.withColumns(
        {
            "ext": ext,
            "wants_body": wants,
            "body_file": F.when(has_body & fits, name),
            "body_skipped": F.when(has_body & ~fits, F.lit("too large")),
        }
    )


def visited_url_templates(
    responses: DataFrame, visit: str = "visit_id", order: str = "ts", bucket: Column | None = None, tie: str = "url"
) -> DataFrame:
    """Add ``url_template``: the page pattern between consecutive listing URLs of a visit.

    Responses of one time follow each other by ``tie``.

    The previous URL is found in two levels, within time buckets (hours by default) and across them, so
    that a visit with very many responses spreads over many tasks.
    """
    responses = responses.withColumn("_bucket", F.floor(F.col(order) / 3600) if bucket is None else bucket)
    across = Window.partitionBy(visit).orderBy("_bucket")
    within = Window.partitionBy(visit, "_bucket").orderBy(order, tie)
    carried = (
        responses.groupBy(visit, "_bucket")
        .agg(F.max_by("url", F.struct(order, tie)).alias("_last"))
        .select(visit, "_bucket", F.lag("_last").over(across).alias("_carried"))
    )
    before = F.when(F.row_number().over(within) == 1, F.col("_carried")).otherwise(F.lag("url").over(within))
    return (
        responses.join(carried, [visit, "_bucket"])
        .withColumn("before_url", before)
        .withColumn("url_template", page_url_template(F.col("before_url"), F.col("url")))
        .drop("_bucket", "_carried")
    )
