"""Every query with SQL gives the SQL's rows at the smallest scale, and no oracle match is vacuous."""

import glob
from pathlib import Path

import duckdb
import pytest

from attestry.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    found, wanted = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert rows(found) == rows(wanted)
    assert len(found)
