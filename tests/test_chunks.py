"""Long episodes: cut into chunks they give the values of the whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.operators import execution, signal, spectrum
from trajectra.operators.chunks import chunked

FRAMES = "episode_index long, frame_index int, timestamp double, state array<double>, action array<double>"


def walks():
    """Motions with rests, steps, slow trends, ties and long flat stretches."""
    random = np.random.default_rng(11)
    n = 1000
    t = np.arange(n) / 30
    sway = np.stack([np.sin(t), np.cos(t / 7)], 1)
    rest = np.cumsum(random.normal(size=(n, 2)), 0)
    rest[200:560] = rest[200]
    rest[700:] = rest[700]
    trend = np.stack([t**3 / 1000 + 0.01 * np.sin(9 * t), t], 1)
    return [(t, np.cumsum(random.normal(size=(n, 2)), 0)), (t, sway), (t, rest), (t, trend), (t[:150], sway[:150]), (t[:40], rest[:40]), (t[:1], rest[:1]), (t[:60], np.ones((60, 2))), (t, np.ones((n, 2)))]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(e, i, float(a), [float(v) for v in x], None) for e, (t, xs) in enumerate(walks()) for i, (a, x) in enumerate(zip(t, xs))]
    return spark.createDataFrame(rows, FRAMES).repartition(6).cache()


def test_chunks_hold_their_halo(frames):
    rows = chunked(frames, {"t": F.col("timestamp")}, 128, 96).where("episode_index = 0").orderBy("chunk").collect()
    assert [r["chunk"] for r in rows] == list(range(8))
    for r in rows:
        begin, end = 128 * r["chunk"], min(128 * r["chunk"] + 128, 1000)
        assert r["frame_index"] == list(range(max(begin - 96, 0), min(end + 96, 1000)))
        assert [i for i, own in zip(r["frame_index"], r["own"]) if own] == list(range(begin, end))
    with pytest.raises(ValueError):
        chunked(frames, {}, 10, 96)


def test_smoothed_derivatives(frames):
    def told(size):
        return {(r["episode_index"], r["frame_index"]): r["jerk"] + r["velocity"] for r in signal.features(frames, 1.0, size).collect()}

    whole, cut = told(4096), told(32)
    assert whole.keys() == cut.keys() and len(whole) == frames.count()
    assert all(np.array_equal(whole[k], cut[k], equal_nan=True) for k in whole)


@pytest.mark.parametrize("sigma", [0.0, 1.0])
def test_execution_of_cut_episodes(frames, sigma):
    features = signal.features(frames, sigma).cache()
    whole = {r["episode_index"]: r.asDict() for r in execution.rates(features).collect()}
    cut = {r["episode_index"]: r.asDict() for r in execution.rates(features, 128, 96).collect()}
    assert whole.keys() == cut.keys() == {0, 1, 2, 3, 4, 5, 7, 8}
    for e in whole:
        assert whole[e].keys() == cut[e].keys()
        for name, value in whole[e].items():
            assert (value is None and cut[e][name] is None) or cut[e][name] == pytest.approx(value, rel=1e-9), (e, name)
    assert max(r["movement_units"] for r in whole.values()) > 20 and max(r["submovements"] for r in whole.values()) > 50


def test_prominence_against_its_definition():
    random = np.random.default_rng(2)
    for n in (5, 40, 300):
        for _ in range(30):
            x = random.normal(size=n).cumsum().round(1)
            for limit in (0.1, 0.7, 2.0):
                want = []
                for p in execution.maxima(x).tolist():
                    higher = np.flatnonzero(x > x[p])
                    left, right = higher[higher < p], higher[higher > p]
                    a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else n)
                    if x[p] - max(x[a : p + 1].min(), x[p:b].min()) >= limit:
                        want.append(p)
                assert execution.peaks(x, limit).tolist() == want


def test_spectrum_in_two_steps(spark):
    random = np.random.default_rng(4)
    signals = {1: random.normal(size=700) ** 2, 2: np.abs(np.sin(np.arange(1500) / 9)), 3: np.zeros(300)}
    rows = spark.createDataFrame([(e, i, float(v), len(x), 0.02 * e) for e, x in signals.items() for i, v in enumerate(x)], "episode_index long, i long, x double, n long, dt double")
    got = {r["episode_index"]: r["sparc"] for r in spectrum.arc_lengths(rows.repartition(5)).collect()}
    assert set(got) == {1, 2}
    for e in got:
        assert got[e] == pytest.approx(execution.sparc(signals[e], 0.02 * e), rel=1e-9)


def test_poses_of_columns_are_those_of_numpy(spark):
    from trajectra.operators import robots

    random = np.random.default_rng(7)
    for kind in robots.ROBOTS:
        dof = len(robots.DH[kind])
        x = random.uniform(-3, 3, (5, dof))
        rows = spark.createDataFrame([(0, i, 0.0, v.tolist(), None) for i, v in enumerate(x)], FRAMES)
        want = robots.frames_of(x, robots.DH[kind])
        got = robots.joint_poses(rows, kind).orderBy("frame_index", "joint").collect()
        assert len(got) == 5 * (dof + 1)
        for r in got:
            pose = want[r["frame_index"], r["joint"]]
            assert np.allclose(r["position"], pose[:3, 3]) and np.allclose(r["axis"], pose[:3, 2])
            j = min(r["joint"], dof - 1)
            step = want[r["frame_index"], j + 1, :3, 3] - want[r["frame_index"], j, :3, 3]
            length = np.linalg.norm(step)
            assert np.allclose(r["direction"], step / length if length > 1e-10 else [0, 0, 1])
    state = np.array([r["state"] for r in robots.joint_samples(spark, "panda", 2000).collect()])
    arm = robots.robot("panda")
    assert (state >= arm["lower"]).all() and (state <= arm["upper"]).all()
    share = (state - arm["lower"]) / (np.array(arm["upper"]) - arm["lower"])
    assert all(abs(np.histogram(share[:, j], 10, (0, 1))[0] - 200).max() < 30 for j in range(7))


def test_peaks_as_column_expressions(spark):
    from trajectra.functions import peaks

    random = np.random.default_rng(12)
    signals = [[], [1.0], [1.0, 1.0], [0, 1, 0, 2, 2, 2, 0, 0.5, 0.4, 3, 0], *[random.normal(size=n).cumsum().round(k).tolist() for n in (3, 20, 90) for k in (0, 1) for _ in range(12)]]
    rows = spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(signals)], "id int, x array<double>").repartition(3)
    for depth, distance in ((0.05, 1), (1.0, 1), (1.0, 5), (0.3, 3)):
        got = {r["id"]: r["p"] for r in peaks.with_peaks(rows, "x", F.lit(depth), distance, "p").collect()}
        for i, s in enumerate(signals):
            assert got[i] == execution.peaks(np.array(s, dtype=float), depth, distance).tolist(), (i, depth, distance)
