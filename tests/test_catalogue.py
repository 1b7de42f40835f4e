"""Every query with SQL equals DuckDB at the smallest scale."""

import pytest

from parlance import catalogue, catalogue_records  # noqa: F401

from .conftest import sql_differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert sql_differences(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ([], [], 0)


def test_flagship_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
