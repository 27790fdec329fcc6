"""Every query of the core runs on the small tables, and gives the rows of its SQL where it has one."""

import pytest
from conftest import SMALL
from harness import connect, differences

from tracemill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SMALL)
    assert rows.count() > 0
