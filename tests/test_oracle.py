"""Every registered query with an equivalent, against DuckDB."""

import pytest

from hornbeam.plans import catalog
from tests.oracle import compare

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(catalog.queries()[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())
