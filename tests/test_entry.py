"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
