"""Every query that has SQL against DuckDB, and the others for rows, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from trajectra import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "events lineitem orders embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
        pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
