"""Site health carried from batch to batch of finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.operators.health import health_history
from cardmill.streaming.harvest import batches_of, remove_batches


BUCKETS = 64


def update_health(runs: DataFrame, batch_id: int, folder: str, order: str = "run_at", buckets: int = BUCKETS, expire: str | None = None) -> None:
    """Judge a batch of runs against the stored counts; write its history and the new state.

    ``folder``/history gets the judged runs, ``folder``/state one row (slug, count, last run) per site, in buckets of sites.
    A batch reads and writes the buckets of the sites it has, each as of the last batch that had it, and then removes what is
    older than that. The previous state enters as one earlier 'ok' run per site. Both tables are written per batch, so a
    repeated batch gives the same ones. Sites whose last run is older than the batch's newest by the interval ``expire``
    (like '90 days') are forgotten when their bucket is written.
    """
    spark = runs.sparkSession
    history, state = f"{folder}/history", f"{folder}/state"
    bucket = F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in runs.select(bucket).distinct().collect())  # at most ``buckets`` numbers
    earlier = {b: {n: p for n, p in batches_of(spark, f"{state}/bucket={b}").items() if n < batch_id} for b in touched}
    paths = [versions[max(versions)] for versions in earlier.values() if versions]
    seeded = runs.withColumn("_seed", F.lit(False))
    before = None
    if paths:
        before = spark.read.parquet(*paths)
        seeds = before.join(runs.select("slug").distinct(), "slug", "left_semi").select(
            "slug",
            F.col("last_run").alias(order),
            F.col("count").alias("n_jobs"),
            F.lit("ok").alias("status"),
            F.lit(True).alias("_seed"),
        )
        seeded = seeded.unionByName(seeds, allowMissingColumns=True)
    judged = health_history(seeded, order).filter(~F.col("_seed")).drop("_seed")
    judged.write.mode("overwrite").parquet(f"{history}/batch_id={batch_id}")
    latest = spark.read.parquet(f"{history}/batch_id={batch_id}").select("slug", F.col(order).alias("last_run"), "count")
    newest = latest.agg(F.max("last_run").alias("newest"))
    if before is not None:
        latest = latest.unionByName(before.select("slug", "last_run", "count"))
    kept = latest.groupBy("slug").agg(F.max(F.struct("last_run", "count")).alias("s")).select("slug", "s.*")
    if expire is not None:
        kept = kept.join(newest, F.col("last_run") >= F.col("newest") - F.expr(f"INTERVAL {expire}"), "left_semi")
    kept = kept.withColumns({"bucket": bucket, "batch_id": F.lit(batch_id)}).repartition("bucket")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(state)
    for b, versions in earlier.items():
        if versions:  # the last version before this batch is what a repeat of it reads
            remove_batches(spark, f"{state}/bucket={b}", max(versions))


def health_stream(runs: DataFrame, folder: str, checkpoint: str, order: str = "run_at", trigger: dict | None = None, **options) -> StreamingQuery:
    """Keep the health of the sites up to date as finished runs arrive, in run order. ``trigger`` are the arguments of the
    writer's trigger; by default all that is there is read once."""
    return (
        runs.writeStream.foreachBatch(lambda batch, batch_id: update_health(batch, batch_id, folder, order, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
