"""Every query of the reports' catalogue against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def told(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return "-"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(told(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    got, want = rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()), rows(duck.sql(catalogue.ORACLE[name]).df())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
