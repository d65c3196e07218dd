"""Every query that SQL can express, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tabguard.queries import files, packs, rows, wide

ORACLE = {**rows.ORACLE, **wide.ORACLE, **files.ORACLE, **packs.ORACLE}
QUERIES = {**rows.QUERIES, **wide.QUERIES, **files.QUERIES, **packs.QUERIES}


def plain(df, columns):
    def cell(v):
        return "null" if pd.isna(v) else str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))
