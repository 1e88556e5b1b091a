import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from cardmill.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", shuffle_partitions=4)
    return ship_package(session)


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a column function over rows of string arguments: evaluate(fn, [(a, b), …]) -> [result, …]."""
    from pyspark.sql import functions as F

    def run(fn, rows):
        width = len(rows[0])
        schema = ", ".join(["i int"] + [f"c{k} string" for k in range(width)])
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = df.select("i", fn(*[F.col(f"c{k}") for k in range(width)]).alias("out")).collect()
        return [r.out for r in sorted(out, key=lambda r: r.i)]

    return run
