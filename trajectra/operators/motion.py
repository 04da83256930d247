"""Motion metrics of episodes from derivatives: jerk, acceleration, velocity, smoothness, path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.functions.vectors import clip, in_order, norm, ratio, whole_episode
from trajectra.operators.ordering import running


def measured(features: DataFrame) -> DataFrame:
    """Per frame: the magnitudes and the pieces that the episode sums need, in one window pass."""
    ahead = F.lead("timestamp").over(in_order()) - F.col("timestamp")
    rows = features.withColumns({"speed": norm(F.col("velocity")), "accel": norm(F.col("acceleration")), "jolt": norm(F.col("jerk")), "ahead": F.when(ahead == 0, F.lit(1e-6)).otherwise(ahead)})
    rows = rows.withColumns({"step": F.coalesce(norm(F.zip_with("state", F.lag("state").over(in_order()), lambda a, b: a - b)), F.lit(0.0)), "d_accel": F.col("accel") - F.lag("accel").over(in_order())})
    jolt, spread = F.avg("jolt").over(whole_episode()), F.stddev_pop("jolt").over(whole_episode())
    return rows.withColumns({"jolt_outlier": (spread >= 1e-10) & (F.abs(F.col("jolt") - jolt) > 2 * spread), "accel_jump": F.abs("d_accel") > 3 * F.stddev_pop("d_accel").over(whole_episode())})


def episode_metrics(features: DataFrame) -> DataFrame:
    """One row per episode with at least two frames."""
    rows = measured(features)
    first, last = F.min_by("state", "frame_index"), F.max_by("state", "frame_index")
    sums = rows.groupBy("episode_index").agg(
        F.count("*").alias("n"),
        (F.max("timestamp") - F.min("timestamp")).alias("duration"),
        F.sum("step").alias("path"),
        norm(F.zip_with(last, first, lambda a, b: a - b)).alias("straight"),
        F.avg("jolt").alias("mean_jerk"), F.stddev_pop("jolt").alias("std_jerk"), F.max("jolt").alias("max_jerk"),
        F.coalesce(F.sum(F.col("jolt") * F.col("jolt") * F.col("ahead")), F.lit(0.0)).alias("jerk_cost"),
        F.sum(F.col("jolt_outlier").cast("int")).alias("jerk_outliers"),
        F.avg("accel").alias("mean_accel"), F.stddev_pop("accel").alias("std_accel"), F.sqrt(F.avg(F.col("accel") * F.col("accel"))).alias("rms_accel"),
        F.sum(F.col("accel_jump").cast("int")).alias("accel_jumps"),
        F.avg("speed").alias("mean_speed"), F.stddev_pop("speed").alias("std_speed"), F.max("speed").alias("peak_speed"), F.sqrt(F.avg(F.col("speed") * F.col("speed"))).alias("rms_speed"),
        F.min_by(F.col("timestamp"), F.struct(-F.col("speed"), F.col("frame_index"))).alias("peak_at"), F.min("timestamp").alias("start"),
    ).where("n >= 2")
    moves = (F.col("duration") > 0) & (F.col("path") > 0)
    length2 = F.col("path") * F.col("path")
    argument = F.col("jerk_cost") * F.pow("duration", F.lit(5)) / F.when(moves, length2)
    return sums.select(
        "*",
        F.coalesce(F.col("jerk_cost") * F.pow("duration", F.lit(3)) / F.when(moves, length2), F.lit(0.0)).alias("normalised_jerk"),
        F.when(F.col("mean_jerk") > 0, 1 / (1 + F.col("mean_jerk") / 100)).otherwise(F.lit(1.0)).alias("jerk_score"),
        F.when(moves & (argument > 0), -F.ln(F.when(argument > 0, argument))).otherwise(F.lit(0.0)).alias("ldlj"),
        F.when(F.col("std_accel") > 0, 1 / (1 + F.col("std_accel") / 10)).otherwise(F.lit(1.0)).alias("accel_score"),
        (100.0 * F.col("accel_jumps") / F.greatest(F.col("n") - 1, F.lit(1))).alias("accel_jump_pct"),
        (100.0 * F.col("jerk_outliers") / F.col("n")).alias("jerk_outlier_pct"),
        F.when(F.col("mean_speed") > 0, 1 / (1 + F.col("std_speed") / F.when(F.col("mean_speed") > 0, F.col("mean_speed")))).otherwise(F.lit(0.5)).alias("speed_score"),
        F.when(F.col("duration") > 0, ratio(F.col("peak_at") - F.col("start"), F.col("duration"))).otherwise(F.lit(0.5)).alias("time_to_peak"),
        F.when(F.col("path") < 1e-10, F.lit(1.0)).otherwise(F.least(ratio(F.col("straight"), F.col("path"), 1.0), F.lit(1.0))).alias("efficiency"),
    ).withColumn("ldlj_score", clip((F.col("ldlj") + 10) / 20, 0.0, 1.0))


def motion_quality(features: DataFrame, smoothness: DataFrame | None = None) -> DataFrame:
    """episode_metrics with the overall score; smoothness (episode_index, smooth_score) replaces LDLJ."""
    rows = episode_metrics(features)
    smooth: Column = F.col("ldlj_score")
    if smoothness is not None:
        rows, smooth = rows.join(smoothness, "episode_index", "left"), F.coalesce("smooth_score", F.lit(0.5))
    overall = 0.35 * F.col("jerk_score") + 0.35 * smooth + 0.15 * F.col("accel_score") + 0.10 * F.col("speed_score") + 0.05 * F.col("efficiency")
    return rows.withColumn("overall_score", overall)


def path_efficiency(frames: DataFrame) -> DataFrame:
    """Path length, straight distance and efficiency of every episode."""
    step = norm(F.zip_with("state", F.lag("state").over(in_order()), lambda a, b: a - b))
    rows = frames.withColumn("step", F.coalesce(step, F.lit(0.0)))
    ends = F.zip_with(F.max_by("state", "frame_index"), F.min_by("state", "frame_index"), lambda a, b: a - b)
    sums = rows.groupBy("episode_index").agg(F.count("*").alias("n"), F.sum("step").alias("path"), norm(ends).alias("straight"))
    return sums.withColumn("efficiency", F.when((F.col("n") < 2) | (F.col("path") < 1e-10), F.lit(1.0)).otherwise(F.least(ratio(F.col("straight"), F.col("path"), 1.0), F.lit(1.0))))


def jerk_ranks(metrics: DataFrame) -> DataFrame:
    """jerk_rank_score: share of the reference episodes (T > 0, L > 0) whose jerk is larger."""
    reference = ((F.col("duration") > 0) & (F.col("path") > 0)).cast("int")
    counted = running(metrics, "normalised_jerk", F.coalesce(reference, F.lit(0)), "at_most_", "sum_").withColumnRenamed("sum_", "all_")
    lg = F.log10(F.when(F.col("normalised_jerk") > 0, F.col("normalised_jerk")))
    alone = F.when(F.col("normalised_jerk") <= 1e4, 1.0).when(F.col("normalised_jerk") <= 1e5, 1 - (lg - 4) * 0.3).when(F.col("normalised_jerk") <= 1e6, 0.7 - (lg - 5) * 0.4).otherwise(F.greatest(0.3 - (lg - 6) * 0.3, F.lit(0.0)))
    return counted.withColumn("jerk_rank_score", F.when(F.col("all_") > 0, (F.col("all_") - F.col("at_most_")) / F.when(F.col("all_") > 0, F.col("all_"))).otherwise(alone)).drop("at_most_", "all_")
