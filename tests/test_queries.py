"""Registered queries against their SQL twins on the smallest data."""

import pytest
from check_oracles import compare, database

import __spark_entry__ as entry_module

FAST = [n for n in entry_module.oracle_sql() if not n.startswith("stream_")]


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir).startswith("ok")


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
