"""Every registered query: equal to its SQL, or at least some rows where SQL cannot say it."""

import pytest
from oracle import compare, connect

from commentlab.plans import ENTRIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_equals_sql(spark, sf, con, name):
    # "no rows" is fine here: some filters keep nothing of the smallest tables.
    assert compare(ENTRIES[name].run(spark, sf), con, ENTRIES[name].sql) in ("", "no rows")


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql])
def test_query_without_sql_has_rows(spark, sf, name):
    assert ENTRIES[name].run(spark, sf).limit(1).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
