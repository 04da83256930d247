"""Principal axes of more vectors than the former sample, with variances so close that power iteration is still under way."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from trajectra import catalog


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    random = np.random.default_rng(9)
    scale = np.r_[2.0, 1.003, np.ones(62)]
    x = random.normal(size=(10_500, 64)) * scale
    path = tmp_path_factory.mktemp("axes")
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x.astype(np.float32)), "label": (np.arange(len(x)) % 10).astype(np.int32)}).to_parquet(path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["embedding_voxels", "embedding_loadings", "pca_embeddings"])
def test_all_vectors_on_the_axes_of_the_sql(spark, folder, name):
    got = catalog.QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(catalog.SQL[name]).df()
    order = lambda df: df[sorted(want.columns)].sort_values(sorted(want.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, atol=2e-6)
