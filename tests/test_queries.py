"""Every named query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from marlstone import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if v == v else "nan"
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(v) for v in r.values()] for r in df.select(cols).toArrow().to_pylist()), key=repr)
    if name not in catalog.oracle_sql():
        assert got
        return
    want = con.sql(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(want.column_names) == cols
    assert got == sorted(([plain(v) for v in r.values()] for r in want.select(cols).to_pylist()), key=repr)


def test_names_have_functions_and_checks():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 100
