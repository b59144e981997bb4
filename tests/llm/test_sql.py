"""Operators that SQL can express give DuckDB's rows, over the smallest test tables and over a fixture of odd rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm.minhash import near_groups
from tessera.llm.queries import QUERIES
from tessera.llm.repetition import repetition
from tessera.llm.sql import ORACLE_SQL
from tessera.llm.suffixes import repeated_passages

FOLDER = "/root/testdata/sf0.001"


def same(got, con, sql):
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_tables(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    same(QUERIES[name](spark, FOLDER), con, ORACLE_SQL[name])


def test_odd_rows(spark):
    long = " ".join(f"w{i % 97}x{i % 89}é" for i in range(400))
    rows = [(1, None), (2, ""), (3, "one"), (4, "One!"), (5, long), (6, long.upper()), (7, f"Ünd {long} zzz"), (8, "a\n" * 400), (9, "Ä ß ö " * 60), (None, long), (10, "#%$ \n\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same(repetition(df), con, ORACLE_SQL["op2_repetition"])
    same(near_groups(df), con, ORACLE_SQL["op1_near_duplicates"])
    same(repeated_passages(df).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end"), con, ORACLE_SQL["op9_repeated_passages"])
