"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as E
from tests.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", list(E.queries()))
def test_query(spark, con, name):
    n, _, _, diff = compare(spark, con, SF, name)
    assert diff is None and n > 0


def test_functions_travel_with_their_tasks():
    from pyspark import cloudpickle

    assert "passagework" in cloudpickle.list_registry_pickle_by_value()


def test_entry(spark):
    assert E.entry(spark).count() > 0
