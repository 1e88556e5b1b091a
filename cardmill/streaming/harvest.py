"""Harvesting pages as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.operators.jobs import harvest_first_seen
from cardmill.plans.scrape import extract_pages
from cardmill.session import grown, materialize


def first_seen_within(rows: DataFrame, keys: Sequence[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """Streaming rows without repeats of their key inside the watermark; older state is dropped."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def folder(spark: SparkSession, path: str):
    """A folder and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def has_batches(spark: SparkSession, table: str) -> bool:
    """Whether a table written batch by batch exists yet."""
    fs, path = folder(spark, table)
    return fs.exists(path)


def batches_of(spark: SparkSession, table: str) -> dict[int, str]:
    """The folders of a table's batches, by number."""
    fs, path = folder(spark, table)
    if not fs.exists(path):
        return {}
    found = (f.getPath() for f in fs.listStatus(path) if f.isDirectory())
    return {int(p.getName().partition("=")[2]): p.toString() for p in found if p.getName().startswith("batch_id=")}


def remove_batches(spark: SparkSession, table: str, before: int) -> None:
    """Delete the batches of a table before a number."""
    fs, _ = folder(spark, table)
    for number, path in batches_of(spark, table).items():
        if number < before:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def append_first_seen(
    rows: DataFrame, batch_id: int, table: str, site: Sequence[str] = ("slug",), order: Sequence[str] = ("page_no", "pos"),
    remember: int | None = None,
) -> None:
    """Append the rows whose key is new, as one batch of the table.

    A batch overwrites its own folder and looks only at earlier batches, so a repeated batch gives the
    same table. Rows meet stored ones on (site, key), of which only the keys are read.

    With ``remember`` the keys that a batch has seen, new or not, are kept for so many batches in a log beside the table (at
    ``<table>-keys``), and a batch reads that log only: what it reads and keeps does not grow with the stream. A key that was
    in none of these batches counts as new again. Without it all keys of the table count, for ever.
    """
    spark = rows.sparkSession
    key = [*site, "job_key"]
    fresh = harvest_first_seen(rows, site, order)
    log = f"{table}-keys"
    if remember is not None:
        fresh = materialize(fresh)
        fresh.select(*key).write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        paths = [path for number, path in batches_of(spark, log).items() if batch_id - remember <= number < batch_id]
        if paths:
            fresh = fresh.join(spark.read.parquet(*paths).select(*key).distinct(), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        remove_batches(spark, log, batch_id - remember)  # a batch may be repeated, those before it not
        return
    if batch_id > 0 and has_batches(spark, table):
        known = spark.read.parquet(table).filter(F.col("batch_id") < batch_id).select(*key)
        fresh = fresh.join(known, key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def harvest_stream(
    source: DataFrame, table: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None, **options
) -> StreamingQuery:
    """Run a stream of pages (or of extracted rows, without ``extract``) into a first-seen table.

    ``trigger`` are the arguments of the writer's trigger; by default all that is there is read once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_first_seen(extract(batch) if extract else batch, batch_id, table, **options)

    return (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def page_extractor(sites: DataFrame, page_no: str = "page_no") -> Callable[[DataFrame], DataFrame]:
    """Extraction step for ``harvest_stream``: pages with slug and page_no to rows."""
    sites = materialize(sites)

    def extract(batch: DataFrame) -> DataFrame:
        rows = extract_pages(batch, sites)
        return rows.join(grown(batch.select("page_id", F.col(page_no).alias("page_no"))), "page_id")

    return extract
