"""Every query with SQL gives the same rows on DuckDB; the others give rows."""

import os

import parity
import pytest

from lodestar import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return parity.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql:
        assert parity.compare(spark, duck, name, query, sql, SF) == ""
    else:
        assert query(spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(NAMES)
