"""Every registered query against its check SQL on the smallest tables."""

import __spark_entry__ as entry
import compare
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_has_sql():
    from speechspark.plans.oracle import ORACLE
    from speechspark.plans.queries import REGISTRY

    assert set(REGISTRY) == set(ORACLE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    assert compare.differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 3
