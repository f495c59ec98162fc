"""Every core query against its SQL."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from sievewright.plans.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def views(folder):
    con = duckdb.connect()
    import glob
    import os

    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(pdf):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) or str(v) == "NaT" else str(v)
    return sorted(tuple(map(str, map(plain, r))) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, folder, views, name):
    got, want = QUERIES[name](spark, folder).toPandas(), views.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_alone(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark, folder):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
