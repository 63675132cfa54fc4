"""Every query gives what its SQL gives on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from shelflot.plans import catalog, oracle
from tests.parity import check, connect

DIRECTORY = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    found, _ = check(spark, con, DIRECTORY, name, entry.queries()[name], entry.oracle_sql()[name])
    assert found is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["section", "item", "metric", "value"]
    assert df.count() > 0
