"""Contiguous shards of nearly equal bytes: prefix sums over all rows, cut at equal targets.

Rows are range-partitioned and sorted by their order columns; within a partition the sums run along as a stream. Only one
total per partition reaches the driver, where it becomes the partition's start. A row goes to the shard in whose equal part
of all bytes its middle lies, so a shard misses its target by no more than the longest row.

Defined results: no rows give no rows. Rows that tie in the order columns are told apart by their place in the input, so a
repeated row spreads over partitions and shards like others. Null order values come first. Input columns ``shard`` and
``slot`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.llm.tables import materialize, replace_columns


def running_sums(names: list[str], size: str):
    """Adds the partition, and rows and bytes before each row in it."""

    def run(batches):
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            sizes = batch.column(names.index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            new = [pa.array(np.full(n, part, np.int32)), pa.array(rows + np.arange(n, dtype=np.int64)), pa.array(ends - sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "__part", "__rows", "__bytes"])
            rows, total = rows + n, int(ends[-1]) if n else total

    return run


def contiguous_shards(docs: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """The rows with ``shard`` and ``slot``, the gapless place in the shard. ``size`` is a column of positive lengths."""
    spark = docs.sparkSession
    docs = replace_columns(docs, "shard", "slot")
    placed = docs.withColumn("__at", F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`") for c in order] + [F.col("__at")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    placed = materialize(placed.mapInArrow(running_sums(placed.columns, size), f"{schema}, __part int, __rows long, __bytes long"))
    # one row per partition
    totals = sorted(placed.groupBy("__part").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect())
    starts, n, total = [], 0, 0
    for part, count, length in totals:
        starts.append((part, n, total))
        n, total = n + count, total + length
    before = F.broadcast(spark.createDataFrame(starts, "__part int, __n long, __total long"))
    rows = placed.join(before, "__part").withColumn("__row", F.col("__n") + F.col("__rows"))
    middle = f"(2 * (__total + __bytes) + `{size}`)"
    rows = rows.withColumn("shard", F.expr(f"cast({middle} * cast({shards} as decimal(20, 0)) div {max(1, 2 * total)} as int)"))
    first = rows.groupBy("shard").agg(F.min("__row").alias("__first"))
    first = F.broadcast(spark.createDataFrame(first.collect(), "shard int, __first long"))  # one row per shard
    return rows.join(first, "shard").withColumn("slot", F.col("__row") - F.col("__first")).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (none of a null) and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
