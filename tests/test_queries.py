"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from checks.compare import difference, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        problem = difference(got, con.execute(ORACLES[name]).fetchdf())
        assert problem is None, problem


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
