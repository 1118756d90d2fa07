"""Every query of the catalog against its SQL, on the smallest driver tables (skipped where they are absent)."""

import numbers
import os

import pandas as pd
import pytest

import __spark_entry__
from millrace.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: None if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, numbers.Number) else str(x)
    return sorted((tuple(cell(x) for x in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)


@needs_data
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "window_start"


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
