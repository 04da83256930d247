"""Consistency of recordings: timing, alignment, gaps, limits and anomalies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.functions.vectors import INFINITY, finite, in_order, whole_episode
from trajectra.operators import selection
from trajectra.operators.neighbours import outlier_factors
from trajectra.operators.robots import robot, within_limits
from trajectra.sources.tables import written


def alignment(frames: DataFrame) -> DataFrame:
    """alignment_score per episode: penalties for missing parts and for odd time steps."""
    rows = frames.withColumn("dt", F.col("timestamp") - F.lag("timestamp").over(in_order()))
    rows = rows.withColumn("jump", F.col("dt") > F.avg("dt").over(whole_episode()) + 3 * F.stddev_pop("dt").over(whole_episode()))
    sums = rows.groupBy("episode_index").agg(F.count("state").alias("states"), F.count("action").alias("actions"), F.count("timestamp").alias("times"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("backward", F.col("dt") < 0), ("standing", F.col("dt") == 0), ("jumps", F.col("jump")))])
    penalty = lambda c, by: F.when(c, by).otherwise(1.0)
    checks = [(F.col("states") != F.col("actions"), 0.5), (F.col("states") != F.col("times"), 0.5), (F.col("backward"), 0.7), (F.col("standing"), 0.9), (F.col("jumps"), 0.95)]
    score, issues = F.lit(1.0), F.lit(0)
    for c, by in checks:
        score, issues = score * penalty(c, by), issues + c.cast("int")
    return sums.select("episode_index", score.alias("alignment_score"), issues.alias("n_issues"), (issues == 0).alias("aligned"))


def temporal(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Mean and deviation of the frame rate, jitter, dropouts and temporal_score per episode."""
    rows = frames.withColumn("dt", F.col("timestamp") - F.lag("timestamp").over(in_order()))
    rate = 1 / (F.col("dt") + 1e-10)
    sums = rows.groupBy("episode_index").agg(F.count("*").alias("n"), F.avg(rate).alias("fps_mean"), F.stddev_pop(rate).alias("fps_std"), F.stddev_pop("dt").alias("dt_std"), F.sum((F.col("dt") > 2 / fps).cast("int")).alias("dropouts"))
    some = F.col("n") >= 2
    pct = 100.0 * F.col("dropouts") / F.greatest(F.col("n") - 1, F.lit(1))
    jitter = F.col("dt_std") * fps
    score = 0.6 * F.greatest(1 - jitter / 0.5, F.lit(0.0)) + 0.4 * F.greatest(1 - pct / 10, F.lit(0.0))
    zero = lambda c: F.when(some, c).otherwise(F.lit(0.0))
    return sums.select("episode_index", "n", zero(F.col("fps_mean")).alias("fps_mean"), zero(F.col("fps_std")).alias("fps_std"), zero(jitter).alias("jitter"), F.when(some, F.col("dropouts")).otherwise(F.lit(0)).alias("dropouts"), zero(pct).alias("dropout_pct"), zero(score).alias("temporal_score"))


def _count(vector: str, what) -> Column:
    return F.coalesce(F.size(F.filter(vector, what)), F.lit(0))


def presence(frames: DataFrame) -> DataFrame:
    """Which parts each episode has, and whether NaN or infinite numbers occur in them."""
    bad = lambda c: F.coalesce(F.exists(c, lambda x: F.isnan(x)), F.lit(False))
    return frames.groupBy("episode_index").agg(F.bool_or(F.col("state").isNotNull()).alias("has_states"), F.bool_or(F.col("action").isNotNull()).alias("has_actions"), F.bool_or(F.col("timestamp").isNotNull()).alias("has_timestamps"), F.bool_or(bad("state")).alias("nan_states"), F.bool_or(bad("action")).alias("nan_actions"))


def missing(frames: DataFrame) -> DataFrame:
    """One row: complete episodes, NaN and infinite elements per frame in percent, missing_score."""
    per = frames.groupBy("episode_index").agg(
        F.count("*").alias("n"), ((F.count("state") > 0) & (F.count("action") > 0) & (F.count("timestamp") > 0)).alias("complete"),
        *[F.sum(_count("state", f) + _count("action", f)).alias(k) for k, f in (("nans", lambda x: F.isnan(x)), ("infs", lambda x: F.abs(x) == F.lit(INFINITY)))],
    )
    sums = per.agg(F.count("*").alias("episodes"), F.coalesce(F.sum(F.col("complete").cast("int")), F.lit(0)).alias("complete"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames"), F.coalesce(F.sum("nans"), F.lit(0)).alias("nans"), F.coalesce(F.sum("infs"), F.lit(0)).alias("infs"))
    pct = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.nullif(F.col(b), F.lit(0))).otherwise(F.lit(0.0))
    rows = sums.select("episodes", pct("complete", "episodes").alias("completeness_pct"), pct("nans", "frames").alias("nan_pct"), pct("infs", "frames").alias("inf_pct"))
    return rows.withColumn("missing_score", 0.7 * F.col("completeness_pct") / 100 + 0.3 * F.greatest(1 - (F.col("nan_pct") + F.col("inf_pct")) / 200, F.lit(0.0)))


def limit_check(frames: DataFrame, kind: str) -> DataFrame:
    """One row: frames beyond the robot's limits and limit_score."""
    sums = frames.agg(F.count("*").alias("frames"), F.coalesce(F.sum((~within_limits(F.col("state"), kind)).cast("int")), F.lit(0)).alias("violations"))
    pct = F.when(F.col("frames") > 0, 100.0 * F.col("violations") / F.nullif(F.col("frames"), F.lit(0))).otherwise(F.lit(0.0))
    return sums.withColumn("violation_pct", pct).withColumn("limit_score", F.greatest(1 - F.col("violation_pct") / 10, F.lit(0.0)))


def joint_violations(frames: DataFrame, kind: str) -> DataFrame:
    """Per joint the frames below and above its limits, without tolerance."""
    r = robot(kind)
    low, high = (F.array(*[F.lit(float(v)) for v in r[k]]) for k in ("lower", "upper"))
    long = frames.select(F.posexplode("state").alias("joint", "x")).where(F.col("joint") < r["dof"])
    return long.groupBy("joint").agg(F.sum((F.col("x") < F.get(low, F.col("joint"))).cast("int")).alias("below"), F.sum((F.col("x") > F.get(high, F.col("joint"))).cast("int")).alias("above"))


def validated(frames: DataFrame, kind: str | None = None) -> DataFrame:
    """valid and issues of every episode."""
    rows = frames.withColumn("back", F.col("timestamp") < F.lag("timestamp").over(in_order()))
    odd = lambda c: F.coalesce(F.exists(c, lambda x: ~finite(x)), F.lit(False))
    checks = {
        "missing_states": F.count("state") == 0, "missing_actions": F.count("action") == 0, "missing_timestamps": F.count("timestamp") == 0,
        "length_mismatch": (F.count("state") != F.count("action")) | (F.count("state") != F.count("timestamp")),
        "states_not_finite": F.coalesce(F.bool_or(odd("state")), F.lit(False)), "actions_not_finite": F.coalesce(F.bool_or(odd("action")), F.lit(False)),
        "time_runs_back": F.coalesce(F.bool_or("back"), F.lit(False)),
    }
    if kind:
        r = robot(kind)
        checks["joint_limits"] = F.coalesce(F.bool_or((F.size("state") == r["dof"]) & ~within_limits(F.col("state"), kind)), F.lit(False))
    sums = rows.groupBy("episode_index").agg(F.count("*").alias("n_frames"), *[c.alias(n) for n, c in checks.items()])
    absent = F.col("missing_states") | F.col("missing_actions") | F.col("missing_timestamps")
    issues = F.array_compact(F.array(*[F.when(F.col(n) & (F.lit(n.startswith("missing")) | ~absent), F.lit(n)) for n in checks]))
    return sums.select("episode_index", "n_frames", (F.size(issues) == 0).alias("valid"), F.array_join(issues, ",").alias("issues"))


def _neighbours(x: np.ndarray, ids: np.ndarray, sample: np.ndarray, names: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places) of each row's k nearest sampled points other than itself; ties go to the smaller id.

    sample is in the order of names, so among equal distances an earlier place is a smaller id.
    """
    distances, places = [], []
    for at in range(0, len(x), block):
        gap = np.sqrt(((x[at : at + block, None, :] - sample[None]) ** 2).sum(axis=2)) if sample.shape[1] * len(sample) <= 1 << 16 else np.stack([np.sqrt(((row - sample) ** 2).sum(axis=1)) for row in x[at : at + block]])
        gap[ids[at : at + block, None] == names[None]] = np.inf
        near = np.argsort(gap, axis=1, kind="stable")[:, :k]
        distances.append(np.take_along_axis(gap, near, axis=1))
        places.append(near)
    return (np.concatenate(distances), np.concatenate(places)) if distances else (np.zeros((0, k)), np.zeros((0, k), int))


def local_outlier_factor(points: DataFrame, k: int = 20, sample_rows: int | None = None, seed: int = 42) -> DataFrame:
    """id, lof of every row of points(id, x: array): the density of its k neighbours over its own.

    Neighbours are the nearest of all rows.  With sample_rows, which is an approximation, they are looked for among
    that many drawn by a seeded order, which every task holds; each row gets its factor
    either way.
    """
    if sample_rows is None:
        return outlier_factors(points, k)
    drawn = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).select("id", "x").collect()
    drawn.sort(key=lambda r: r["id"])
    if len(drawn) < 2:
        return points.select("id", F.lit(1.0).alias("lof"))
    names, sample = np.array([r["id"] for r in drawn], dtype=np.int64), np.array([r["x"] for r in drawn], dtype=float)
    k = min(k, len(drawn) - 1)
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((names, sample))

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sample = shared.value
        for frame in frames:
            if len(frame):
                at = frame["place"].to_numpy()
                distances, places = _neighbours(sample[at], names[at], sample, names, k)
                yield pd.DataFrame({"place": at, "d": list(distances), "p": list(places)})

    rows = spark.range(len(drawn)).select(F.col("id").alias("place")).mapInPandas(near, "place long, d array<double>, p array<long>").orderBy("place").collect()
    gap, place = np.array([r["d"] for r in rows]), np.array([r["p"] for r in rows], dtype=int)
    reach = gap[:, -1]
    density = 1 / (np.maximum(gap, reach[place]).mean(axis=1) + 1e-10)
    facts = spark.sparkContext.broadcast((reach, density))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (names, sample), (reach, density) = shared.value, facts.value
        for frame in frames:
            if len(frame):
                ids = frame["id"].to_numpy()
                gap, place = _neighbours(np.stack(frame["x"].to_list()).astype(float), ids, sample, names, k)
                own = 1 / (np.maximum(gap, reach[place]).mean(axis=1) + 1e-10)
                yield pd.DataFrame({"id": ids, "lof": density[place].mean(axis=1) / own})

    return points.select("id", "x").mapInPandas(run, "id long, lof double")


def local_anomalies(points: DataFrame, contamination: float = 0.1) -> DataFrame:
    """id, lof, anomaly: rows below the contamination's quantile of the negated factors."""
    scores = local_outlier_factor(points)
    scores = written(scores, "factors")
    (limit,) = selection.quantiles(scores, -F.col("lof"), [contamination])
    return scores.withColumn("anomaly", -F.col("lof") < F.lit(limit))


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_trees(sample: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42) -> list:
    """Trees as nested (dimension, cut, left, right) with leaves of expected path lengths."""
    random = np.random.default_rng(seed)
    size = min(size, len(sample))
    most = math.ceil(math.log2(max(2, size)))

    def grow(x: np.ndarray, depth: int):
        low, high = x.min(axis=0), x.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= most or len(x) <= 1 or not len(open_):
            return depth + _path(len(x))
        d = int(random.choice(open_))
        cut = float(random.uniform(low[d], high[d]))
        side = x[:, d] < cut
        return (d, cut, grow(x[side], depth + 1), grow(x[~side], depth + 1)) if side.any() and not side.all() else depth + _path(len(x))

    return [grow(sample[random.choice(len(sample), size, replace=False)], 0) for _ in range(trees)]


def isolation_scores(points: DataFrame, sample_rows: int = 10_000, seed: int = 42) -> DataFrame:
    """id, score of every row of points(id, x); trees are grown on a bounded seeded sample."""
    rows = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).collect()
    if not rows:
        return points.select("id", F.lit(None).cast("double").alias("score"))
    sample = np.array([r["x"] for r in rows], dtype=float)
    trees, unit = isolation_trees(sample, seed=seed), _path(min(256, len(sample))) or 1.0

    def depth(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        out, side = np.empty(len(x)), x[:, tree[0]] < tree[1]
        out[side], out[~side] = depth(tree[2], x[side]), depth(tree[3], x[~side])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["x"].to_list()) if len(frame) else np.zeros((0, sample.shape[1]))
            yield pd.DataFrame({"id": frame["id"], "score": 2 ** (-sum(depth(t, x) for t in trees) / len(trees) / unit)})

    return points.select("id", "x").mapInPandas(run, "id long, score double")


def anomalies(scores: DataFrame, contamination: float = 0.1) -> DataFrame:
    """scores with anomaly: above the quantile that leaves the contamination."""
    scores = written(scores, "scores")
    (limit,) = selection.quantiles(scores, "score", [1 - contamination])
    return scores.withColumn("anomaly", F.col("score") > F.lit(limit))


def anomaly_check(frames: DataFrame) -> DataFrame:
    """One row: anomaly, which is 1 less a twentieth of the per cent of anomalous frames, and 1 below 10 frames.

    Frames without a finite state can't be scored and don't count.
    """
    points = frames.where(F.col("state").isNotNull() & F.forall("state", finite)).select(F.xxhash64("episode_index", "frame_index").alias("id"), F.col("state").alias("x"))
    sums = anomalies(isolation_scores(points)).agg(F.count("*").alias("n"), F.avg(F.col("anomaly").cast("int")).alias("share"))
    return sums.select(F.when(F.col("n") < 10, F.lit(1.0)).otherwise(F.greatest(1 - 100 * F.col("share") / 20, F.lit(0.0))).alias("anomaly"))


def consistency(frames: DataFrame, fps: float = 30.0, kind: str | None = None, anomaly_score: float | None = None) -> DataFrame:
    """One row: the five component scores and their weighted overall score (anomaly_score instead of the check, if given)."""
    aligned = alignment(frames).agg(F.avg("alignment_score").alias("alignment"))
    timed = temporal(frames, fps).agg(F.avg("temporal_score").alias("temporal"))
    limits = limit_check(frames, kind).select(F.col("limit_score").alias("limits")) if kind else None
    rows = aligned.join(F.broadcast(timed)).join(F.broadcast(missing(frames).select(F.col("missing_score").alias("missing"), "completeness_pct")))
    rows = rows.join(F.broadcast(limits)) if limits is not None else rows.withColumn("limits", F.lit(1.0))
    rows = rows.join(F.broadcast(anomaly_check(frames))) if anomaly_score is None else rows.withColumn("anomaly", F.lit(float(anomaly_score)))
    return rows.withColumn("overall_score", 0.25 * F.col("alignment") + 0.25 * F.col("temporal") + 0.20 * F.col("missing") + 0.20 * F.col("anomaly") + 0.10 * F.col("limits"))


def first_frames(frames: DataFrame) -> DataFrame:
    w = Window.partitionBy("episode_index").orderBy("frame_index")
    return frames.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")
