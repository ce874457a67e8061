"""Every log query against its SQL twin; those without one have tests of their own."""

from __future__ import annotations

import pytest

from tests.oracle import DATA, assert_same
from tideline.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
WITHOUT_SQL = {"crc32_verify", "topic_partition_hash"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, DATA), ORACLES[name])


def test_all_others_are_named():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
