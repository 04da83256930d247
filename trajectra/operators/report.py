"""Rule-driven report: a rules table range-joined to metric scores, and the overall health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (category, metric, from, below, priority); a rule fires where from <= score < below.
RULES = [
    ("execution", "movement_units", None, 0.5, "HIGH"), ("execution", "movement_units", 0.5, 0.7, "MEDIUM"),
    ("execution", "hesitations", None, 0.5, "HIGH"), ("execution", "hesitations", 0.5, 0.7, "MEDIUM"),
    ("execution", "submovements", None, 0.5, "HIGH"), ("execution", "submovements", 0.5, 0.7, "MEDIUM"),
    ("execution", "jerk", None, 0.3, "HIGH"), ("execution", "jerk", 0.3, 0.5, "MEDIUM"),
    ("spatial", "coverage_limited", None, None, "HIGH"), ("spatial", "coverage_moderate", None, None, "MEDIUM"),
    ("spatial", "starting_variance", None, 0.4, "MEDIUM"), ("spatial", "angle_diversity", None, 0.4, "MEDIUM"),
    ("consistency", "overall", None, 0.6, "HIGH"), ("consistency", "anomalies", None, 0.95, "MEDIUM"),
    ("consistency", "completeness", None, 0.95, "MEDIUM"), ("consistency", "temporal", None, 0.7, "MEDIUM"),
]
ADVICE = {
    "movement_units": ("Motions break into many separate strokes", "Record again with one flowing motion per goal", "Rehearse the path before recording"),
    "hesitations": ("The arm keeps slowing down and starting over", "Plan the whole motion before starting it", "Practise until the pace is even"),
    "submovements": ("Small corrections crowd the motion", "Aim earlier so that fewer corrections are needed", "Slow the approach, steady the hand"),
    "jerk": ("Acceleration changes abruptly", "Filter the commands or move more gently", "Raise the smoothing of the controller"),
    "coverage_limited": ("Only a small part of the space was visited", "Vary start poses and goals", "Plan a grid of start poses"),
    "coverage_moderate": ("Parts of the space were not visited", "Add episodes in the empty regions", "Look at the voxel map and fill its gaps"),
    "starting_variance": ("Episodes begin in nearly the same pose", "Shift the start pose between episodes", "Draw start poses at random"),
    "angle_diversity": ("Goals are approached from the same side", "Approach from several directions", "Turn the object between episodes"),
    "overall": ("The recordings do not fit together", "Check clocks, limits and gaps before training", "Validate every episode when recording"),
    "anomalies": ("Some frames look unlike all others", "Inspect and drop the flagged frames", "Watch the flagged episodes"),
    "completeness": ("Some episodes lack states, actions or times", "Drop or record them again", "Check the recorder's channels"),
    "temporal": ("Frames come at uneven times", "Fix the recorder's rate", "Record on an idle machine"),
}


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(i, c, m, lo, hi, p, {"HIGH": 0, "MEDIUM": 1, "LOW": 2}[p], *ADVICE[m]) for i, (c, m, lo, hi, p) in enumerate(RULES)]
    return spark.createDataFrame(rows, "seq int, category string, metric string, low double, high double, priority string, rank int, issue string, advice string, technique string")


def recommendations(metrics: DataFrame) -> DataFrame:
    """Fired rules of metrics(category, metric, score) in order of priority, score and rule."""
    rules = F.broadcast(rules_table(metrics.sparkSession))
    fires = (F.coalesce(F.col("score") >= F.col("low"), F.lit(True))) & F.coalesce(F.col("score") < F.col("high"), F.lit(True)) & F.col("score").isNotNull()
    fired = metrics.join(rules, ["category", "metric"]).where(fires)
    return fired.orderBy("rank", "score", "seq").select("priority", "category", "metric", "score", "issue", "advice", "technique")


def by_category(found: DataFrame) -> DataFrame:
    """category, rules, HIGH, MEDIUM, LOW, first: the fired rules of each category, and the metric of its first one in order."""
    rank = F.element_at(F.create_map(F.lit("HIGH"), F.lit(0), F.lit("MEDIUM"), F.lit(1), F.lit("LOW"), F.lit(2)), F.col("priority"))
    counts = [F.count_if(F.col("priority") == p).alias(p) for p in ("HIGH", "MEDIUM", "LOW")]
    return found.groupBy("category").agg(F.count("*").alias("rules"), *counts, F.min_by("metric", F.struct(rank, "score", "metric")).alias("first"))


def priority_counts(found: DataFrame) -> DataFrame:
    names = ["HIGH", "MEDIUM", "LOW"]
    sums = found.agg(*[F.count_if(F.col("priority") == p).alias(p) for p in names])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(p).alias("priority"), F.col(p).alias("count")) for p in names])).alias("r")).select("r.*")


def health(scores: DataFrame) -> DataFrame:
    """One row from scores(part, score): execution .4, spatial .3, consistency .3 of those present."""
    weight = F.when(F.col("part") == "execution", 0.4).when(F.col("part").isin("spatial", "consistency"), 0.3)
    sums = scores.where("score is not null").withColumn("w", weight).where("w is not null").agg(F.sum(F.col("w") * F.col("score")).alias("a"), F.sum("w").alias("b"))
    return sums.select(F.coalesce(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), F.lit(0.0)).alias("health_score"))


def comprehensive(execution: DataFrame, spatial: DataFrame, consistency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fired rules, one row with health_score and the number of rules by priority) from the three parts' results.

    execution: metric, mean (execution_summary).  spatial: overall_score, start, angle,
    coverage_share.  consistency: overall_score, anomaly_share, completeness_pct, temporal.
    """
    names = {"units_score": "movement_units", "hesitation_score": "hesitations", "submovement_score": "submovements", "jerk_score": "jerk"}
    name = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("metric"))
    metrics = execution.select(F.lit("execution").alias("category"), name.alias("metric"), F.col("mean").alias("score")).where("metric is not null")

    def told(rows: DataFrame, category: str, pairs: list) -> DataFrame:
        facts = F.array(*[F.struct(F.lit(category).alias("category"), F.lit(m).alias("metric"), c.cast("double").alias("score")) for m, c in pairs])
        return rows.select(F.explode(facts).alias("m")).select("m.*")

    share, overall = F.col("coverage_share"), F.col("overall_score")
    metrics = metrics.unionByName(told(spatial, "spatial", [
        ("coverage_limited", F.when(share < 0.15, overall)), ("coverage_moderate", F.when((share >= 0.15) & (share < 0.3), overall)),
        ("starting_variance", F.col("start")), ("angle_diversity", F.col("angle")),
    ]))
    metrics = metrics.unionByName(told(consistency, "consistency", [("overall", overall), ("anomalies", 1 - F.col("anomaly_share")), ("completeness", F.col("completeness_pct") / 100), ("temporal", F.col("temporal"))]))
    parts = execution.where("metric = 'overall_score'").select(F.lit("execution").alias("part"), F.col("mean").alias("score"))
    for part, rows in (("spatial", spatial), ("consistency", consistency)):
        parts = parts.unionByName(rows.select(F.lit(part).alias("part"), F.col("overall_score").alias("score")))
    found = recommendations(metrics)
    counts = priority_counts(found).groupBy().pivot("priority", ["HIGH", "MEDIUM", "LOW"]).agg(F.sum("count"))
    return found, health(parts).join(F.broadcast(counts))
