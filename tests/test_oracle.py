"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from lawloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def duck(sql):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = con.sql(sql)
    return rows_of(out.columns, out.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == duck(ORACLE_SQL[name])
