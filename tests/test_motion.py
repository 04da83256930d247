import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.functions.vectors import gaussian_kernel
from trajectra.operators import execution, motion, report, robots, signal, spatial, stats, success

FRAMES = "episode_index long, frame_index int, timestamp double, state array<double>, action array<double>"


def frames_of(spark, episodes):
    rows = [(e, i, float(t), [float(v) for v in x], [float(v) for v in x]) for e, (ts, xs) in enumerate(episodes) for i, (t, x) in enumerate(zip(ts, xs))]
    return spark.createDataFrame(rows, FRAMES)


def smooth(t):
    return np.stack([50 * np.sin(2 * np.pi * 0.5 * t + 0.1 * i) for i in range(6)], 1)


def jerky(t, seed):
    random = np.random.default_rng(seed)
    return smooth(t) + 10 * np.sin(2 * np.pi * 3 * t)[:, None] + random.normal(0, 5, (len(t), 6))


def test_smoothed_derivatives_match_numpy(spark):
    t = np.linspace(0, 1, 12)
    x = np.random.default_rng(1).normal(size=(12, 2))
    got = {r["frame_index"]: r for r in signal.features(frames_of(spark, [(t, x)]), 1.0).collect()}
    w = np.array(gaussian_kernel(1.0))
    v = np.diff(x, axis=0) / np.diff(t)[:, None]
    v = np.concatenate([v[:1], v])
    padded = np.pad(v, ((4, 4), (0, 0)), mode="symmetric")
    want = np.stack([np.convolve(padded[:, d], w, "valid") for d in range(2)], 1)
    assert np.allclose([got[i]["velocity"] for i in range(12)], want)


def test_window_and_numpy_derivatives_agree(spark):
    t = np.array([0.0, 0.1, 0.1, 0.3])
    rows = signal.features(frames_of(spark, [(t, [[0], [1], [2], [4]])])).orderBy("frame_index").collect()
    assert np.allclose([r["velocity"][0] for r in rows], [10, 10, 1e6, 10])


def test_skilled_beats_unskilled(spark):
    t = np.linspace(0, 5, 100)
    episodes = [(t, smooth(t)) for _ in range(3)] + [(t, jerky(t, s)) for s in range(3)]
    rows = {r["episode_index"]: r for r in execution.execution_scores(signal.features(frames_of(spark, episodes), 1.0)).collect()}
    good, bad = np.mean([rows[i]["overall_score"] for i in range(3)]), np.mean([rows[i]["overall_score"] for i in range(3, 6)])
    assert good - bad > 0.2 and all(0 <= r["overall_score"] <= 1 for r in rows.values())


def test_short_and_constant_episodes(spark):
    frames = frames_of(spark, [([0.0], [[1, 2]]), ([0.0, 1.0], [[1, 2], [1, 2]]), ([0.0, 0.0, 1.0], [[0, 0], [1, 1], [2, 2]])])
    rows = {r["episode_index"]: r for r in motion.motion_quality(signal.features(frames)).collect()}
    assert set(rows) == {1, 2} and rows[1]["efficiency"] == 1.0 and rows[1]["ldlj"] == 0.0
    assert {r["episode_index"] for r in motion.path_efficiency(frames).collect()} == {0, 1, 2}


def test_straight_line(spark):
    row = motion.path_efficiency(frames_of(spark, [([0, 1, 2], [[0, 0, 0], [1, 1, 1], [2, 2, 2]])])).first()
    assert row["efficiency"] == pytest.approx(1.0)


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 0.5, 0.4, 3, 0], float)
    assert execution.peaks(x, 0.0).tolist() == [1, 4, 7, 9]
    assert execution.peaks(x, 0.5).tolist() == [1, 4, 9]
    assert execution.peaks(x, 0.0, 5).tolist() == [4, 9]
    assert execution.peaks(np.ones(5), 0.0).tolist() == []


def test_normalise(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "id int, x double")
    assert [r["normalised"] for r in stats.normalised(rows, "x").orderBy("id").collect()] == [1, 0.75, 0.5, 0.25, 0]
    assert {r["normalised"] for r in stats.normalised(rows.selectExpr("id", "2D x"), "x").collect()} == {0.5}


def test_histogram_of_one_value(spark):
    rows = stats.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 0, 3, 0] and rows[0]["low"] == 1.5


def test_correlation_of_a_constant(spark):
    row = stats.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double"), "x", "y").first()
    assert row["r"] == 0.0 and row["strength"] == "weak"


def test_unknown_names():
    with pytest.raises(ValueError):
        robots.robot("arm9000")


def test_kinematics_of_the_zero_pose():
    for kind in robots.ROBOTS:
        dh = robots.DH[kind]
        pose = robots.frames_of(np.zeros((1, len(dh))), dh)[0, -1]
        want = np.eye(4)
        for d, a, alpha in dh:
            c, s = np.cos(alpha), np.sin(alpha)
            want = want @ np.array([[1, 0, 0, a], [0, c, -s, 0], [0, s, c, d], [0, 0, 0, 1]])
        assert np.allclose(pose, want)


def test_rules(spark):
    metrics = spark.createDataFrame([("execution", m, s) for m, s in (("movement_units", 0.3), ("hesitations", 0.3), ("submovements", 0.3), ("jerk", 0.2))], "category string, metric string, score double")
    assert [r["priority"] for r in report.recommendations(metrics).collect()] == ["HIGH"] * 4
    assert {r["priority"]: r["count"] for r in report.priority_counts(report.recommendations(metrics)).collect()} == {"HIGH": 4, "MEDIUM": 0, "LOW": 0}
    scores = spark.createDataFrame([("execution", 0.8), ("spatial", 0.7), ("consistency", 0.9)], "part string, score double")
    assert report.health(scores).first()[0] == pytest.approx(0.80)
    assert report.health(scores.limit(0)).first()[0] == 0.0


def test_problem_episodes(spark):
    scores = spark.createDataFrame([(i, q) for i, q in enumerate((0.8, 0.2, 0.7, 0.1, 0.9))], "episode_idx long, quality_score double")
    rows = {r["episode_idx"]: r["kind"] for r in success.problem_episodes(scores, spark.createDataFrame([(1,), (3,)], "episode_idx long")).collect()}
    assert rows == {1: "single", 3: "multiple"}


@pytest.mark.parametrize("most, first", [(0, 1), (100_000, 20_000), (100_000, 13)])
def test_leaders(spark, most, first, monkeypatch):
    monkeypatch.setattr(spatial, "MOST_LEADERS", most)
    monkeypatch.setattr(spatial, "FIRST_OPEN", first)
    frames = frames_of(spark, [(range(4), [[0, 0, 0], [0.1, 0, 0], [5, 0, 0], [5.1, 0, 0]])])
    assert sorted(r["x"] for r in spatial.leaders(frames, 1.0).collect()) == [[0, 0, 0], [5, 0, 0]]
    random = np.random.default_rng(4)
    points = random.normal(size=(200, 3)).round(1)
    found = []
    for p in points:  # one by one, in order
        if all(np.linalg.norm(p - q) > 0.8 for q in found):
            found.append(p)
    got = spatial.leaders(frames_of(spark, [(range(100), points[:100]), (range(100), points[100:])]), 0.8)
    assert sorted(r["x"] for r in got.collect()) == sorted(p.tolist() for p in found)
    assert spatial.leaders(frames.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_numbering_and_running_sums(spark, few, monkeypatch):
    from trajectra.operators import ordering
    from trajectra.operators.ordering import numbered, running

    monkeypatch.setattr(ordering, "FEW", few)
    values = np.random.default_rng(8).permutation(1000)
    rows = spark.createDataFrame([(int(v), int(v) // 7) for v in values], "k long, v long").repartition(5)
    assert all(r["place"] == r["k"] for r in numbered(rows, "k").collect())
    got = {r["v"]: (r["upto"], r["whole"]) for r in running(rows, "v", F.lit(1), "upto", "whole").collect()}
    assert all(upto == min(7 * (v + 1), 1000) and whole == 1000 for v, (upto, whole) in got.items())
    assert numbered(rows.limit(0), "k").count() == 0


def test_savgol_against_fits(spark):
    t, x = np.arange(12.0), np.random.default_rng(2).normal(size=(12, 2))
    frames = frames_of(spark, [(t, x), (t[:3], x[:3])])
    got = {(r["episode_index"], r["frame_index"]): r["smoothed"] for r in signal.smoothed_signal(frames, "savgol", 6).collect()}
    for i in range(12):
        start = min(max(i - 3, 0), 12 - 7)
        for d in range(2):
            fit = np.polyfit(np.arange(7), x[start : start + 7, d], 3)
            assert got[0, i][d] == pytest.approx(np.polyval(fit, i - start))
    assert np.allclose([got[1, i] for i in range(3)], x[:3])
    with pytest.raises(ValueError):
        signal.smoothed_signal(frames, "other")


def test_single_frames_and_files(spark, tmp_path):
    from trajectra.sources import frames as src

    frames = frames_of(spark, [(range(3), [[0], [1], [2]]), (range(2), [[3], [4]])])
    assert src.frame_at(frames, 3).first()["state"] == [3.0] and [r["frame_index"] for r in src.episode(frames, 1).collect()] == [0, 1]
    for bad in (lambda: src.frame_at(frames, 5), lambda: src.frame_at(frames, -1), lambda: src.episode(frames, 2)):
        with pytest.raises(ValueError):
            bad()
    src.write_frames(frames, f"{tmp_path}/frames")
    back = src.read_frames(spark, f"{tmp_path}/frames", 1)
    assert back.count() == 3 and "episode_index" in back._jdf.queryExecution().toString().split("PushedFilters")[1]
    assert src.loaded(spark, f"{tmp_path}/frames", "sequential", 1).count() == 3
    assert src.camera_names(frames.withColumn("observation.images.top", F.lit(1))) == ["top"]
    assert src.video_path(7, "top", lambda p: "observation" in p) == "videos/observation.images.top/episode_000007.mp4" and src.video_path(7, "top", lambda p: False) is None
    assert ("state", "array<double>") in [tuple(r) for r in src.features(frames).collect()]


def test_settings(tmp_path):
    pytest.importorskip("yaml")
    from trajectra.sources.config import Config

    config = Config({"robot": {"type": "so-arm100"}, "metrics.spatial_coverage.voxel_size": 0.1})
    assert config.robot_type == "so-arm100" and config.robot_dof == 6 and config.get("metrics.spatial_coverage.voxel_size") == 0.1
    assert config.get("no.such", 5) == 5 and config.section("dataset")["cache_dir"] == "data"
    config.save(tmp_path / "c.yaml")
    assert Config.load(tmp_path / "c.yaml").values == config.values


def test_outlier_factors_on_a_sample(spark):
    from trajectra.operators import consistency

    x = np.random.default_rng(3).normal(size=(60, 4))
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    whole = {r["id"]: r["lof"] for r in consistency.local_outlier_factor(points, 5).collect()}
    part = {r["id"]: r["lof"] for r in consistency.local_outlier_factor(points, 5, sample_rows=30).collect()}
    assert set(whole) == set(part) == set(range(60))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.diag([np.inf] * 60)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    gap = np.take_along_axis(d, near, axis=1)
    lrd = 1 / (np.maximum(gap, gap[:, -1][near]).mean(axis=1) + 1e-10)
    assert np.allclose([whole[i] for i in range(60)], lrd[near].mean(axis=1) / lrd)
    assert [r["lof"] for r in consistency.local_outlier_factor(points.limit(1)).collect()] == [1.0]


def test_scores_need_a_source(spark):
    with pytest.raises(ValueError):
        success.quality_scores([])
    a = spark.createDataFrame([(1, 0.2), (2, 0.4)], "episode_index long, score double")
    b = spark.createDataFrame([(1, 0.6)], "episode_index long, score double")
    assert {r[0]: round(r[1], 6) for r in success.quality_scores([a, b]).collect()} == {1: 0.4, 2: 0.4}


def test_events_as_a_stream(spark, tmp_path):
    from trajectra.streaming import ingest

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.option("compression", "snappy").parquet(f"{tmp_path}/one")
    (file,) = [p for p in (tmp_path / "one").iterdir() if p.suffix == ".parquet"][:1]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a-events.parquet").write_bytes(file.read_bytes())
    rows = ingest.episode_sessions(ingest.events_stream(spark, str(folder), events.schema))
    query = rows.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    got = spark.table("sessions")
    assert got.columns == ["episode_index", "start", "end", "frames", "low", "high", "mean"] and got.count() > 0


def test_anomaly_is_computed(spark):
    from trajectra.operators import consistency

    def score(states):
        rows = [(1, i, i / 30, s, s) for i, s in enumerate(states)]
        frames = spark.createDataFrame(rows, "episode_index long, frame_index int, timestamp double, state array<double>, action array<double>")
        return consistency.consistency(frames).first()["anomaly"]

    varied = np.random.default_rng(5).normal(size=(100, 3)).tolist()
    assert score(varied) == pytest.approx(0.5)
    assert score(varied[:9]) == 1
    assert score([[1.0, 2.0, 3.0]] * 50) == 1
    assert score([*varied[:9], None, [float("nan"), 0.0, 0.0]]) == 1
