"""The driver's contract: entry() gives rows, every SQL has its query."""

import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows[0].n >= rows[-1].n


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
