import os

import pytest

import __spark_entry__ as entry_points
from check_queries import compare, oracle
from runlens.plans.catalog import catalog

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query_equals_its_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_its_sql():
    assert set(catalog()) <= set(entry_points.oracle_sql())
