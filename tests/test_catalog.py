"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loomspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    null = lambda v: v is None or v is pd.NA or v is pd.NaT or v != v
    shown = [tuple("null" if null(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False)]
    return list(df.columns), sorted(shown)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE:
        want = db.execute(catalog.ORACLE[name]).df()
        assert canonical(got) == canonical(want)
    else:
        assert len(got)
