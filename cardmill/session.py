"""Session helpers: recommended settings, and tables in the shared work folder."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20  # of texts on their way to a Python worker


def local_session(app: str = "cardmill", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # tables bucketed by page meet on page and element without an exchange
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers when it is not installed on the cluster."""
    sc = spark.sparkContext
    if not getattr(sc, "_cardmill_shipped", False):
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(tempfile.mkdtemp() + "/cardmill", "zip", here.parent, here.name)
        sc.addPyFile(archive)
        sc._cardmill_shipped = True
    return spark


@cache
def _local_folder(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="cardmill-")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Folders lie below the application's id, so that a cluster can clear them when the application has ended. Only a session
    that runs on one machine and names no such folder gets a temporary one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _local_folder(spark.sparkContext.applicationId)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table to the shared work folder and read it back.

    Used where several branches of a plan read the result of a Python step, so that the step runs once
    and a lost executor costs a file read instead of a parse. With ``by`` it is written in as many buckets of that column as
    a shuffle has partitions, so that joins of such tables on it (and, where ``spark.sql.requireAllClusterKeysForCoPartition``
    is off, on it and more columns) need no exchange. The table's name is dropped at once, its files stay.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    if by is None:
        df.write.parquet(path)
        return spark.read.parquet(path)
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"cardmill_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def bounded_batches(df: DataFrame) -> DataFrame:
    """The table, after its session's Arrow batches are held to a size in bytes, as a batch of 10,000 texts has none."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_in_bytes(conf.get(name)) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def size_in_bytes(setting: str) -> int:
    """A size as Spark's settings write it: a number of bytes, or one with a unit such as ``64m`` or ``1gb``."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def grown(df: DataFrame) -> DataFrame:
    """A table that grows with the input, as a side of a join: the join sorts and merges, and sends no side to the driver.

    Spark judges by the size of files whether a table is small enough to be broadcast. Tables of elements, cards and selectors
    repeat themselves and are compressed up to a hundredfold, so that a few megabytes of files are gigabytes of rows.
    """
    return df.hint("merge")
