"""Job sheets: the labelled 12-column table that people read, as CSV or Parquet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill import fixed
from cardmill.session import materialize


def sheet_cell(c: Column, dtype: T.DataType, max_chars: int | None = None) -> Column:
    """Cell text: lists joined, maps and structs as text, control characters dropped, cut only to a given length.

    Numbers and booleans stay as they are.
    """
    if isinstance(dtype, T.ArrayType):
        c = F.array_join(F.transform(c, lambda v: v.cast("string")), ", ", "None")
    elif isinstance(dtype, (T.MapType, T.StructType)):
        c = F.to_json(c)
    elif not isinstance(dtype, T.StringType):
        return c
    text = F.regexp_replace(F.coalesce(c, F.lit("")), fixed.SHEET_CONTROL_CHARS, "")
    return F.substring(text, 1, max_chars) if max_chars else text


def export_projection(jobs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """The known columns that occur in at least one row, labelled, in fixed order; others are dropped.

    ``max_chars`` is for programs that read no longer cells; by default nothing is cut.

    Which columns occur is found with one aggregate over the rows. If none occurs, the first three
    columns are written empty.
    """
    known = [c for c in fixed.SHEET_COLUMNS if c in jobs.columns]
    present = []
    if known:
        seen = jobs.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in known]).first()
        present = [c for c in known if seen[c]]
    if not present:
        return jobs.select(*[F.lit("").alias(label) for label in list(fixed.SHEET_COLUMNS.values())[:3]])
    return jobs.select(
        *[sheet_cell(F.col(c), jobs.schema[c].dataType, max_chars).alias(fixed.SHEET_COLUMNS[c]) for c in present]
    )


def write_run(jobs: DataFrame, path: str, run_id: str, stage: str) -> str:
    """Write one stage of a run (jobs_raw, jobs_ranked or jobs_ai) as Parquet under path/run_id=…/stage=…."""
    target = f"{path.rstrip('/')}/run_id={run_id}/stage={stage}"
    jobs.write.mode("overwrite").parquet(target)
    return target


def write_job_sheet(jobs: DataFrame, path: str) -> None:
    """Write the labelled sheet as CSV. The rows are computed once, into the work folder."""
    export_projection(materialize(jobs)).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def sheet_key(label: str) -> str:
    """Column key of a sheet label; unknown labels become lower snake case."""
    known = {v: k for k, v in fixed.SHEET_COLUMNS.items()}
    return known.get(label, re.sub(r"\W+", "_", label.lower()).strip("_"))


def read_job_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Read a sheet back: labels to keys, empty cells to null."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(
        *[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(sheet_key(c)) for c in raw.columns]
    )
