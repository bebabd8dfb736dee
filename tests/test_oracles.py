"""Every registered query of the analytics operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from prosewright.plans import catalogue


def rows_of(columns, rows):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(repr(tuple(r[i] for i in at)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLE_SQL:
        assert got[1]
        return
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert got == rows_of(list(rel.columns), rel.fetchall())
