"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from siteloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return round(float(value), 6) if type(value).__name__ == "Decimal" else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = catalog.QUERIES[name](spark, SF)
    expected = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    got = [[x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r] for r in df.collect()]
    assert rows_of(df.columns, got) == rows_of(names, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
