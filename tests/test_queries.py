"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.toArrow().to_pylist()
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda row: tuple(str(row[c]) for c in sorted(names))
    assert sorted(map(key, got)) == sorted(key(dict(zip(names, x))) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["value"] and entry.entry(spark).count() > 0
