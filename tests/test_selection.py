"""Order statistics by range counts against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.operators import selection, stats, success


@pytest.mark.parametrize("few", [0, 40])
def test_ranks(spark, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "ACCURACY", 20)
    random = np.random.default_rng(6)
    for values in (random.normal(size=500), np.exp(random.normal(size=300) * 40), random.integers(0, 4, 400).astype(float), np.array([1e308, -1e308, 5e-324, 0.0, -0.0, 3.5]), np.array([math.inf, -math.inf, math.nan, 2.0, 2.0, 1.0])):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        ranks = sorted({0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1})
        want = np.sort(values)
        got = selection.at_ranks(rows, "x", [*ranks, len(values), -1])
        assert got[-2:] == [None, None]
        assert np.array_equal(np.array(got[:-2], dtype=float), want[ranks], equal_nan=True)


def test_quantiles_are_the_built_in_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(float(v), int(v * 10)) for v in np.random.default_rng(1).normal(size=777)], "x double, k int").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    for column in ("x", "k"):
        want = rows.agg(F.percentile(column, F.array(*[F.lit(s) for s in shares]))).first()[0]
        assert selection.quantiles(rows, column, shares) == want
        monkeypatch.setattr(selection, "FEW", 10)
        assert selection.quantiles(rows, column, shares) == pytest.approx(want, rel=1e-14)
        monkeypatch.undo()
    assert selection.quantiles(rows.limit(0), "x", [0.5]) == [None]
    assert stats.whole_summary(rows.limit(0), F.col("x")).first()["median"] is None


def test_lowest_tenth_with_ties(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 3)
    scores = spark.createDataFrame([(i, float(q)) for i, q in enumerate(np.random.default_rng(3).integers(0, 5, 300))], "episode_idx long, quality_score double").repartition(3)
    want = sorted((r["quality_score"], r["episode_idx"]) for r in scores.collect())
    for k in (1, 30, 77, 300):
        assert sorted((r["quality_score"], r["episode_idx"]) for r in selection.lowest(scores, "quality_score", "episode_idx", k).collect()) == want[:k]
    tenth = success.lowest_tenth(scores)
    assert tenth.count() == 30 and "Limit" not in tenth._jdf.queryExecution().toString()
    assert success.lowest_tenth(scores.limit(0)).count() == 0 and selection.lowest(scores, "quality_score", "episode_idx", 0).count() == 0
