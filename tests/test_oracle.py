"""Every query that has SQL gives DuckDB's rows, on the smallest test tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import tessera.queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else int(x) if x == int(x) else round(x, 9)
    return x.isoformat() if isinstance(x, datetime.date) else x


@pytest.mark.parametrize("name", sorted(tessera.queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER)
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    mine = sorted(str([plain(x) for x in r]) for r in got.select(columns).collect())
    assert mine == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(tessera.queries.ORACLE_SQL) <= set(entry.queries())
