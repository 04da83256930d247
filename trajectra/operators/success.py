"""Episode success: classes, rates, rankings and problem lists from quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.operators import selection


def classified(scores: DataFrame, excellent: float = 0.75, good: float = 0.60, marginal: float = 0.45) -> DataFrame:
    """scores(episode_idx, quality_score, ...) with classification and is_successful."""
    q = F.col("quality_score")
    return scores.withColumns({"classification": F.when(q >= excellent, "excellent").when(q >= good, "good").when(q >= marginal, "marginal").otherwise("poor"), "is_successful": q >= good})


def success_rates(classes: DataFrame) -> DataFrame:
    """Count and share of every class, empty ones too, and the success rate."""
    names = ["excellent", "good", "marginal", "poor"]
    sums = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("is_successful").cast("int")), F.lit(0)).alias("ok"), *[F.count_if(F.col("classification") == c).alias(c) for c in names])
    rows = sums.select("n", "ok", F.explode(F.array(*[F.struct(F.lit(c).alias("classification"), F.col(c).alias("count")) for c in names])).alias("r"))
    share = lambda c: F.when(F.col("n") > 0, c / F.nullif(F.col("n"), F.lit(0))).otherwise(F.lit(0.0))
    return rows.select("r.classification", F.col("r.count").alias("count"), (100 * share(F.col("r.count"))).alias("pct"), share(F.col("ok")).alias("success_rate"))


def best_worst(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k best (ties by index) and the k worst (ties by index, falling) with their place."""
    best = scores.orderBy(F.desc("quality_score"), "episode_idx").limit(k)
    worst = scores.orderBy("quality_score", F.desc("episode_idx")).limit(k)
    place = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  k rows
    a = best.select(F.lit("best").alias("side"), place(F.desc("quality_score"), F.asc("episode_idx")).alias("place"), "episode_idx", "quality_score")
    b = worst.select(F.lit("worst").alias("side"), place(F.asc("quality_score"), F.desc("episode_idx")).alias("place"), "episode_idx", "quality_score")
    return a.unionByName(b)


def tiers(scores: DataFrame) -> DataFrame:
    """Episodes above 0.65, above 0.45 and below, and the best one."""
    q = F.col("quality_score")
    return scores.agg(F.count_if(q > 0.65).alias("excellent"), F.count_if((q > 0.45) & (q <= 0.65)).alias("acceptable"), F.count_if(q <= 0.45).alias("needs_improvement"), F.max_by("episode_idx", F.struct("quality_score", -F.col("episode_idx"))).alias("best_episode"))


def lowest_tenth(scores: DataFrame) -> DataFrame:
    """The lowest tenth of the episodes, one at least, ties by index."""
    n = scores.count()
    return selection.lowest(scores, "quality_score", "episode_idx", max(1, n // 10)) if n else scores


def problem_episodes(scores: DataFrame, anomalous: DataFrame) -> DataFrame:
    """Episodes with an issue: low quality, anomalies, or multiple."""
    rows = lowest_tenth(scores).select("episode_idx", F.lit("low_quality").alias("issue")).unionByName(anomalous.select("episode_idx", F.lit("anomalies").alias("issue")))
    return rows.groupBy("episode_idx").agg(F.array_join(F.array_sort(F.collect_set("issue")), ",").alias("issues"), F.countDistinct("issue").alias("n_issues")).withColumn("kind", F.when(F.col("n_issues") > 1, "multiple").otherwise("single"))


def browsed(scores: DataFrame, by: str, descending: bool = True, k: int = 20) -> DataFrame:
    """The first k episodes by any column, ties by index."""
    return scores.orderBy(F.desc(by) if descending else F.asc(by), "episode_idx").limit(k)


def single_issues(problems: DataFrame, k: int = 20) -> DataFrame:
    """The first k episodes that have one issue."""
    return problems.where("kind = 'single'").orderBy("episode_idx").limit(k).select("episode_idx", "issues")


def quality_scores(sources: list[DataFrame]) -> DataFrame:
    """episode_index, quality_score: the mean of the sources(episode_index, score) that have the episode.

    No source at all is an error: scores are not made up.
    """
    if not sources:
        raise ValueError("no source of quality scores")
    rows = sources[0].select("episode_index", "score")
    for more in sources[1:]:
        rows = rows.unionByName(more.select("episode_index", "score"))
    return rows.groupBy("episode_index").agg(F.avg("score").alias("quality_score"))


def success_level(pct: Column) -> Column:
    return F.when(pct >= 70, "high").when(pct >= 50, "medium").otherwise("low")


def bar_level(score: Column, high: float, middle: float) -> Column:
    """The band of a bar: above the upper bound, above the lower one, or below."""
    return F.when(score >= high, "good").when(score >= middle, "fair").otherwise("weak")


def share_level(pct: Column, much: float = 10, some: float = 5) -> Column:
    """The band of a bar where less is better."""
    return F.when(pct > much, "weak").when(pct > some, "fair").otherwise("good")


def success_indicators(scores: DataFrame) -> DataFrame:
    """One row from scores(episode_index, length, quality_score): counts, rate, quality and its correlation with length."""
    rows = classified(scores.withColumnRenamed("episode_index", "episode_idx"))
    sums = rows.agg(
        F.count("*").alias("n"), F.count_if("is_successful").alias("successful"), F.avg("quality_score").alias("mean_quality"), F.stddev_pop("quality_score").alias("std_quality"), F.avg("length").alias("mean_length"),
        F.coalesce(F.corr("length", "quality_score"), F.lit(0.0)).alias("correlation"), F.max_by("episode_idx", F.struct("quality_score", -F.col("episode_idx"))).alias("best_episode"),
    )
    rate = F.when(F.col("n") > 0, F.col("successful") / F.nullif(F.col("n"), F.lit(0))).otherwise(F.lit(0.0))
    return sums.withColumn("success_rate", rate).withColumn("level", success_level(100 * F.col("success_rate")))


def insight(score: Column, high: float, middle: float, also: Column) -> Column:
    """A three-step label; the highest also needs the second condition."""
    return F.when((score > high) & also, "strong").when(score > middle, "moderate").otherwise("weak")


def level(score: Column) -> Column:
    return F.when(score >= 0.65, "excellent").when(score >= 0.45, "good").when(score >= 0.25, "moderate").otherwise("poor")


def health_label(score: Column) -> Column:
    return F.when(score >= 0.7, "Healthy").when(score >= 0.5, "Moderate").otherwise("Needs Attention")
