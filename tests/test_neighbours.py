"""The neighbour join against all pairs, in small cells and blocks."""

import numpy as np
import pytest

from trajectra.operators import consistency, neighbours


def all_pairs(x, k):
    d = neighbours.gaps(x, x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, order, axis=1), order


@pytest.mark.parametrize("cells, rows, candidates", [(40, 16, 30), (10_000, 2048, 8192)])
def test_nearest(spark, cells, rows, candidates, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cells)
    monkeypatch.setattr(neighbours, "ROWS", rows)
    monkeypatch.setattr(neighbours, "CANDIDATES", candidates)
    random = np.random.default_rng(5)
    # clusters, a far row, and many equal rows, whose neighbours are told by id
    x = np.concatenate([random.normal(size=(150, 3)), random.normal(size=(120, 3)) * 0.1 + 9, np.ones((60, 3)), [[500.0, 0, 0]]]).round(2)
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>").repartition(3)
    gap, place = all_pairs(x, 7)
    got = {r["id"]: r["near"] for r in neighbours.nearest(points, 7).collect()}
    assert len(got) == len(x)
    for i in range(len(x)):
        assert [n["d"] for n in got[i]] == gap[i].tolist() and [n["id"] for n in got[i]] == place[i].tolist()
    reach = gap[:, -1]
    density = 1 / (np.maximum(gap, reach[place]).mean(axis=1) + 1e-10)
    factors = {r["id"]: r["lof"] for r in consistency.local_outlier_factor(points, 7).collect()}
    assert np.allclose([factors[i] for i in range(len(x))], density[place].mean(axis=1) / density)


def test_few_rows(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, x array<double>")
    assert {r["id"]: [tuple(n) for n in r["near"]] for r in neighbours.nearest(points, 20).collect()} == {1: [(1.0, 2)], 2: [(1.0, 1)]}
    assert [r["lof"] for r in neighbours.outlier_factors(points.limit(1)).collect()] == [1.0]
    assert neighbours.outlier_factors(points.limit(0)).count() == 0


def test_vectors_sent_grow_with_the_rows(spark, monkeypatch):
    """In many dimensions, where cells rule out nothing, a vector goes to a fixed number of blocks."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "CANDIDATES", 32)
    x = np.random.default_rng(6).normal(size=(800, 24))
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>").repartition(3)
    context = spark.sparkContext
    jvm, store = context._jvm, context._jsc.sc().statusStore()

    def sent():
        stages = store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = sent()
    got = {r["id"]: r["near"] for r in neighbours.nearest(points, 5).collect()}
    # the two sides' vectors, each row's partial results, and the rest
    assert sent() - before < (3 * neighbours.BLOCKS + 6) * len(x)
    gap, place = all_pairs(x, 5)
    for i in range(len(x)):
        assert [n["d"] for n in got[i]] == gap[i].tolist() and [n["id"] for n in got[i]] == place[i].tolist()
