import __spark_entry__ as entry
from vecloom.catalog_of_queries import QUERIES, SQL


def test_registry():
    assert set(SQL) <= set(QUERIES)
    assert {"p1_found", "p4_found", "p5_found"} <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0].score == 1.0
