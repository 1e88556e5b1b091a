"""Tables that the operators of this package pass around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.session import bounded_batches, materialize, size_in_bytes

BROADCAST_IDS = 250_000  # rows of one or two numbers, about 25 MB as a hash table

__all__ = ["bounded_batches", "checked_rows", "crc_fold", "join_ids", "materialize", "replace_columns", "size_in_bytes", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table without the columns that an operator is about to add: an operator's own columns win over clashing ones."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def crc_fold(key: Column, folds: int = 4) -> Column:
    """The fold of a row, from the CRC-32 of its key as text."""
    return F.crc32(key.cast("string")) % folds


def checked_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """All rows of a table whose size is bounded; an error, never a part of them, when it has more."""
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows


def join_ids(docs: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join with a table of ids: while it has a proven bound of rows the ids are broadcast, so that no text is
    shuffled; beyond that it is a join by shuffle with the same result."""
    ids = materialize(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)
