"""Pair distances: the sample meets itself, without numbering the table again for each pair of partitions."""

import itertools

import numpy as np
import pytest

from trajectra.operators import spatial

FRAMES = "episode_index long, frame_index int, timestamp double, state array<double>, action array<double>"


def test_sample_meets_itself(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 3))
    frames = spark.createDataFrame([(i // 40, i % 40, 0.0, v.tolist(), None) for i, v in enumerate(x)], FRAMES).repartition(7)
    found = spatial.pair_distances(frames, k=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Window" not in plan
    chosen = x[np.floor(np.arange(50) * (399 / 49)).astype(int)]
    want = [np.linalg.norm(a - b) for a, b in itertools.combinations(chosen, 2)]
    (row,) = found.collect()
    assert row["pairs"] == len(want) and row["mean_distance"] == pytest.approx(np.mean(want)) and row["std_distance"] == pytest.approx(np.std(want))


def test_parts_of_the_space_read_written_positions(spark):
    from trajectra import catalog

    plan = catalog.QUERIES["spatial_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan
