"""Every query against its SQL in DuckDB, on the smallest tables."""

import pytest

from catalog import all_oracles, all_queries
from tools.check_oracles import compare, duck

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_oracles_belong_to_queries():
    assert set(all_oracles()) == set(all_queries())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, con, name):
    assert compare(all_queries()[name](spark, SF), con, all_oracles()[name]) == ""


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() == 8
