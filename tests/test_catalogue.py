"""Every registered query against its SQL, on whole tables."""

import os

import pytest

import __spark_entry__ as contract
from catalogue import oracle, queries
from tests.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(SQL) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    assert differences(queries.queries()[name](spark, FOLDER), duck, SQL[name]) is None


def test_comparison_notices_a_change(spark, duck):
    sql = SQL["a15_hot_objects"].replace("count(*)", "count(*) + 1")
    assert "rows" in differences(queries.queries()["a15_hot_objects"](spark, FOLDER), duck, sql)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
