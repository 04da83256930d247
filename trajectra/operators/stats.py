"""Statistics, outliers, histograms and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.functions.vectors import finite, ratio, whole_episode
from trajectra.operators import selection


def summary(x: Column) -> list[Column]:
    """Mean, population deviation, extremes, quartiles and range as aggregates of a group (for all rows: whole_summary)."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), q[1].alias("median"), q[0].alias("p25"), q[2].alias("p75"), (F.max(x) - F.min(x)).alias("range")]


def zscore_outliers(rows: DataFrame, x: str, threshold: float = 3.0) -> DataFrame:
    """outlier: further than threshold deviations from the episode's mean; none if it hardly varies."""
    mean, std = F.avg(x).over(whole_episode()), F.stddev_pop(x).over(whole_episode())
    return rows.withColumns({"mean_": mean, "std_": std}).withColumn("outlier", (F.col("std_") >= 1e-10) & (F.abs(F.col(x) - F.col("mean_")) > threshold * F.col("std_"))).drop("mean_", "std_")


def iqr_outliers(rows: DataFrame, x: str, threshold: float = 1.5) -> DataFrame:
    """outlier: beyond the quartiles by more than threshold times their distance."""
    q = rows.groupBy("episode_index").agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low = F.col("q")[0] - threshold * (F.col("q")[1] - F.col("q")[0])
    high = F.col("q")[1] + threshold * (F.col("q")[1] - F.col("q")[0])
    return rows.join(q, "episode_index").withColumn("outlier", (F.col(x) < low) | (F.col(x) > high)).drop("q")


def high_outliers(rows: DataFrame, x: str, k: float = 2.0) -> DataFrame:
    """outlier: above the episode's mean by more than k deviations."""
    limit = F.avg(x).over(whole_episode()) + k * F.stddev_pop(x).over(whole_episode())
    return rows.withColumn("threshold", limit).withColumn("outlier", F.col(x) > F.col("threshold"))


def row_outliers(frames: DataFrame, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Frames with an outlier in any dimension, judged per dimension over all frames."""
    long = frames.select(F.posexplode("state").alias("dim", "x"))
    if method == "zscore":
        sides = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).select("dim", (F.col("m") - threshold * (F.col("s") + 1e-8)).alias("low"), (F.col("m") + threshold * (F.col("s") + 1e-8)).alias("high"))
    elif method == "iqr":
        dims = frames.agg(F.max(F.size("state"))).first()[0] or 0
        ends = [(d, *selection.quantiles(frames, F.get("state", F.lit(d)), [0.25, 0.75])) for d in range(dims)]
        q = frames.sparkSession.createDataFrame(ends, "dim int, a double, b double")
        sides = q.select("dim", (F.col("a") - threshold * (F.col("b") - F.col("a"))).alias("low"), (F.col("b") + threshold * (F.col("b") - F.col("a"))).alias("high"))
    else:
        raise ValueError(f"method must be zscore or iqr, not {method}")
    # one row with the limits of all dimensions, so the frames need no shuffle
    limits = sides.agg(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("limits_"))
    hit = F.exists(F.arrays_zip(F.col("state").alias("x"), F.col("limits_").alias("s")), lambda p: F.coalesce((p["x"] < p["s"]["low"]) | (p["x"] > p["s"]["high"]), F.lit(False)))
    return frames.where(F.size("state") > 0).join(F.broadcast(limits)).select("episode_index", "frame_index", hit.alias("outlier"))


def percentiles(rows: DataFrame, x: str, shares: tuple[float, ...] = (0.5, 0.75, 0.95)) -> DataFrame:
    """share, value: the exact percentiles of x over all rows."""
    return rows.sparkSession.createDataFrame(list(zip(shares, selection.quantiles(rows, x, list(shares)))), "share double, value double")


def whole_summary(rows: DataFrame, x: Column) -> DataFrame:
    """summary of x over all rows as one row; the quartiles are selected by rank."""
    rows = rows.select(x.alias("x"))
    q = selection.quantiles(rows, "x", [0.25, 0.5, 0.75])
    value = F.col("x")
    sums = rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"))
    return sums.withColumns({name: F.lit(v).cast("double") for name, v in zip(("p25", "median", "p75"), q)})


def weighted(scores: DataFrame, by: list[str], weights: dict[str, float]) -> DataFrame:
    """The weighted mean of scores(by, metric, score): weights count by their total, a metric without one for nothing."""
    total = sum(weights.values())
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("metric")), F.lit(0.0)) if weights else F.lit(1.0)
    value = F.sum(F.col("score") * weight) / (total if total else 1.0) if weights else F.avg("score")
    return scores.groupBy(*by).agg(value.alias("score"))


def metric_summary(rows: DataFrame, name: str, score: str, raw: str, threshold: float | None = None) -> DataFrame:
    """One row: the metric's name, mean score, the summary of its raw values, and whether the score passes."""
    passed = F.col("score") >= threshold if threshold is not None else F.lit(None).cast("boolean")
    sums = rows.agg(F.avg(score).alias("score")).join(F.broadcast(whole_summary(rows, F.col(raw)).drop("n")))
    return sums.select(F.lit(name).alias("metric"), "*").withColumns({"threshold": F.lit(threshold).cast("double"), "passed": passed})


def normalised(rows: DataFrame, x: str, lower_is_better: bool = True) -> DataFrame:
    """x scaled into [0, 1] over all rows, turned round if lower is better; 0.5 if it hardly varies."""
    ends = rows.agg(F.min(x).alias("low_"), F.max(x).alias("high_"))
    span = F.col("high_") - F.col("low_")
    scaled = F.least(F.greatest((F.col(x) - F.col("low_")) / F.when(span < 1e-10, 1.0).otherwise(span), F.lit(0.0)), F.lit(1.0))
    value = F.when(span < 1e-10, F.lit(0.5)).otherwise(1 - scaled if lower_is_better else scaled)
    return rows.join(F.broadcast(ends)).withColumn("normalised", value).drop("low_", "high_")


def histogram(rows: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """bin, count, low, high, centre of equal bins over the range; the last bin is closed."""
    ends = rows.agg(F.min(x).alias("a"), F.max(x).alias("b")).where("a is not null").select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    place = F.least(F.floor((F.col(x) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
    counts = rows.join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    all_bins = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", ((F.col("b") - F.col("a")) / bins).alias("w"))
    low = F.col("a") + F.col("bin") * F.col("w")
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"), low.alias("low"), (low + F.col("w")).alias("high"), (low + F.col("w") / 2).alias("centre"))


def filled(rows: DataFrame, x: str, method: str = "interpolate", by: tuple[str, ...] = ("episode_index",)) -> DataFrame:
    """Numbers that are null, NaN or infinite replaced along the episode (or each group of `by`), or their rows removed."""
    good = F.when(F.col(x).isNotNull() & finite(F.col(x)), F.col(x))
    if method == "remove":
        return rows.withColumn("filled", good).where("filled is not null")
    w = Window.partitionBy(*by).orderBy("frame_index")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(good.isNotNull(), F.struct(F.col("frame_index").alias("i"), good.alias("x")))
    rows = rows.withColumn("point_", point).withColumns({"a_": F.last("point_", True).over(back), "b_": F.first("point_", True).over(ahead)})
    a, b = F.col("a_"), F.col("b_")
    if method == "forward_fill":
        value = F.coalesce(a["x"], b["x"])
    elif method == "interpolate":
        between = a["x"] + (b["x"] - a["x"]) * ratio((F.col("frame_index") - a["i"]).cast("double"), (b["i"] - a["i"]).cast("double"), 0.0)
        value = F.coalesce(between, a["x"], b["x"])
    else:
        raise ValueError(f"method must be interpolate, forward_fill or remove, not {method}")
    return rows.withColumn("filled", value).drop("point_", "a_", "b_")


def repaired(frames: DataFrame, method: str = "interpolate") -> DataFrame:
    """episode_index, frame_index, state, repaired: every dimension of the states filled by itself, and the frame's number of elements that weren't finite.

    remove leaves out the frames with such an element; a dimension without any finite number keeps nulls.
    """
    odd = F.coalesce(F.size(F.filter("state", lambda v: v.isNull() | ~finite(v))), F.lit(0))
    if method == "remove":
        return frames.select("episode_index", "frame_index", "state", odd.alias("repaired")).where(F.col("state").isNotNull() & (F.col("repaired") == 0))
    long = frames.select("episode_index", "frame_index", F.posexplode("state").alias("dim", "x"))
    rows = filled(long, "x", method, ("episode_index", "dim"))
    made = F.transform(F.array_sort(F.collect_list(F.struct("dim", "filled"))), lambda r: r["filled"])
    count = F.count_if(F.col("x").isNull() | ~finite(F.col("x")))
    return rows.groupBy("episode_index", "frame_index").agg(made.alias("state"), count.alias("repaired"))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r (0 where undefined) with its strength, direction, and the fitted line."""
    sums = rows.agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    r = F.when((F.col("n") > 2) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))).otherwise(F.lit(0.0))
    rows = sums.withColumn("r", F.coalesce(r, F.lit(0.0)))
    strength = F.when(F.abs("r") < 0.3, "weak").when(F.abs("r") < 0.6, "moderate").otherwise("strong")
    return rows.select("n", "r", strength.alias("strength"), F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"), "slope", "intercept")
