"""Every registered query of the meter analytics against its SQL on the driver's tables."""

import compare
import pytest

from ohmflow.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    found = catalogue.queries()[name](spark, SF)
    assert len(found.columns) == len(set(found.columns))
    assert not found.isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
