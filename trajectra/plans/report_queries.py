"""Queries over single frames, sampling, scores, labels and the composed results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import consistency, execution, motion, report, signal, spatial, stats, success
from trajectra.plans import execution_sql
from trajectra.plans.motion_queries import DERIVED, EV, EXECUTION, r
from trajectra.plans.quality_queries import SQL as PARTS
from trajectra.plans.quality_queries import AXES, BOUNDS, CELLS, PROJECTED, RECORDED, ROUNDS, SCORES, SMALL, _scores, _small, position_distribution
from trajectra.sources import frames as src
from trajectra.sources.tables import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(EV + " SELECT e AS episode_index, i::INTEGER AS frame_index, x AS value FROM (SELECT *, row_number() OVER (ORDER BY e, i) - 1 AS k FROM g) WHERE k = 100")
def frame_at(spark, d):
    return src.frame_at(src.events_frames(spark, d), 100).select("episode_index", "frame_index", F.get("state", F.lit(0)).alias("value"))


@query(EV + " SELECT k AS id, i::INTEGER AS frame_index FROM (SELECT *, row_number() OVER (ORDER BY e, i) - 1 AS k FROM g) WHERE e = 3")
def episode_frame_ids(spark, d):
    return src.with_ids(src.events_frames(spark, d)).where("episode_index = 3").select("id", "frame_index")


_SAMPLED = "SELECT user_id AS episode_index, count(*) AS frames FROM events {} GROUP BY 1"


def _lengths(spark, d, strategy, most=None):
    frames = src.events_frames(spark, d)
    return src.restricted(frames, src.sampled_episodes(frames, strategy, most)).groupBy("episode_index").agg(F.count("*").alias("frames"))


@query(_SAMPLED.format(""))
def all_episodes(spark, d):
    return _lengths(spark, d, "all", 5)


@query(_SAMPLED.format("WHERE user_id < 20"))
def sequential_sample(spark, d):
    return _lengths(spark, d, "sequential", 20)


@query("WITH s AS (SELECT DISTINCT user_id AS e FROM events), n AS (SELECT count(*) AS n FROM s), k AS (SELECT e FROM (SELECT e, row_number() OVER (ORDER BY md5('42:' || e), e) AS z FROM s), n WHERE n < 500 OR z <= 50) " + _SAMPLED.format("WHERE user_id IN (SELECT e FROM k)"))
def auto_sample(spark, d):
    return _lengths(spark, d, "auto", 50)


# the five-point cubic fit: inside the window's middle, at the edges the first and last fits
_FIT = {0: (69, 4, -6, 4, -1, 70), 1: (2, 27, 12, -8, 2, 35), 2: (-3, 12, 17, 12, -3, 35), 3: (2, -8, 12, 27, 2, 35), 4: (-1, 4, -6, 4, 69, 70)}
_ROWS = " ".join(f"WHEN {k} THEN (" + " + ".join(f"{c} * v[s + {j + 1}]" for j, c in enumerate(f[:5])) + f") / {f[5]}.0" for k, f in _FIT.items())


@query(EV + f", l AS (SELECT e, list(x ORDER BY i) AS v, count(*) AS n FROM g GROUP BY e), p AS (SELECT g.e, i, x, v, n, least(greatest(i - 2, 0), n - 5) AS s FROM g JOIN l ON g.e = l.e) SELECT e AS episode_index, i::INTEGER AS frame_index, round(CASE WHEN n < 5 THEN x ELSE CASE i - s {_ROWS} END END, 6) + 0.0 AS smoothed FROM p")
def savgol_smooth(spark, d):
    return signal.smoothed_signal(src.events_frames(spark, d), "savgol", 4).select("episode_index", "frame_index", r(F.get("smoothed", F.lit(0)), 6, "smoothed"))


@query(EV + " SELECT e AS episode_index, arg_min(x, i) AS x0, max(CASE WHEN i = (n - 1) // 2 THEN x END) AS x1, max(CASE WHEN i = (n - 1) // 2 THEN y END) AS y1, 0.0::DOUBLE AS z1, arg_max(x, i) AS x2, (max((n - 1) // 2) + 1)::BIGINT AS seen FROM (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM g) GROUP BY e")
def path_so_far(spark, d):
    at = lambda c, k, name: F.get(c, F.lit(k)).alias(name)
    return signal.path_so_far(src.events_frames(spark, d)).select("episode_index", at("start", 0, "x0"), at("current", 0, "x1"), at("current", 1, "y1"), at("current", 2, "z1"), at("end", 0, "x2"), "seen")


def _motion(spark, d):
    return motion.episode_metrics(signal.features(src.events_frames(spark, d)))


WEIGHTS = {"jerk": 2.0, "accel": 1.0, "speed": 1.0}


@query(DERIVED + "SELECT episode_index, round((2/(1+mean_jerk/100) + 1/(1+std_accel/10) + 1/(1+std_speed/mean_speed)) / 4, 6) AS score FROM k")
def weighted_scores(spark, d):
    """Three metrics by weight; path efficiency has none and counts for nothing."""
    names = {"jerk": "jerk_score", "accel": "accel_score", "speed": "speed_score", "path": "efficiency"}
    long = _motion(spark, d).select("episode_index", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("score")) for n, c in names.items()])).alias("m")).select("episode_index", "m.*")
    return stats.weighted(long, ["episode_index"], WEIGHTS).select("episode_index", r("score"))


@query(DERIVED + "SELECT 'speed' AS metric, round(avg(1/(1+std_speed/mean_speed)), 6) AS score, round(avg(mean_speed), 4) AS mean, round(stddev_pop(mean_speed), 4) AS std, round(quantile_cont(mean_speed, 0.5), 4) AS median, 0.5::DOUBLE AS threshold, avg(1/(1+std_speed/mean_speed)) >= 0.5 AS passed FROM k")
def metric_summary(spark, d):
    rows = stats.metric_summary(_motion(spark, d), "speed", "speed_score", "mean_speed", 0.5)
    return rows.select("metric", r("score"), r("mean", 4), r("std", 4), r("median", 4), "threshold", "passed")


@query(DERIVED + "SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE, 0.95::DOUBLE]) AS share, unnest([round(quantile_cont(L, 0.5), 4), round(quantile_cont(L, 0.75), 4), round(quantile_cont(L, 0.95), 4)]) AS value FROM k")
def path_percentiles(spark, d):
    return stats.percentiles(_motion(spark, d), "path").select("share", r("value", 4))


@query(SCORES + " SELECT episode_idx, length, q AS quality_score FROM o ORDER BY length DESC, episode_idx LIMIT 20")
def browse_longest(spark, d):
    return success.browsed(_scores(spark, d), "length")


@query(SCORES + " SELECT episode_idx, length, q AS quality_score FROM o ORDER BY q, episode_idx LIMIT 7")
def browse_weakest(spark, d):
    return success.browsed(_scores(spark, d), "quality_score", False, 7)


@query(SCORES + ", n AS (SELECT greatest(1, count(*) // 10) AS k FROM o), l AS (SELECT episode_idx, 'low_quality' AS i FROM (SELECT *, row_number() OVER (ORDER BY q, episode_idx) AS z FROM o), n WHERE z <= k UNION ALL SELECT episode_idx, 'anomalies' FROM o WHERE length < 55) SELECT episode_idx, any_value(i) AS issues FROM l GROUP BY episode_idx HAVING count(*) = 1 ORDER BY episode_idx LIMIT 20")
def single_issue_episodes(spark, d):
    scores = _scores(spark, d)
    return success.single_issues(success.problem_episodes(scores, scores.where("length < 55")))


_OVERALL = DERIVED + ", oa AS (SELECT episode_index, n, 0.35/(1+mean_jerk/100) + 0.35*least(greatest((-ln(cost*T**5/(L*L)) + 10)/20, 0), 1) + 0.15/(1+std_accel/10) + 0.10/(1+std_speed/mean_speed) + 0.05*least(straight/L, 1) AS o, least(straight/L, 1) AS f FROM k), ob AS (SELECT episode_index, n, round((o + f) / 2, 6) AS q FROM oa)"


def _real_scores(spark, d):
    """Quality of an episode: the mean of its motion score and its path efficiency."""
    rows = motion.motion_quality(signal.features(src.events_frames(spark, d)))
    mean = success.quality_scores([rows.select("episode_index", F.col("overall_score").alias("score")), rows.select("episode_index", F.col("efficiency").alias("score"))])
    lengths = src.events_frames(spark, d).groupBy("episode_index").agg(F.count("*").alias("length"))
    return mean.join(lengths, "episode_index").withColumn("quality_score", F.round("quality_score", 6))


@query(_OVERALL + " SELECT episode_index, n AS length, q AS quality_score FROM ob")
def quality_scores(spark, d):
    return _real_scores(spark, d).select("episode_index", "length", "quality_score")


@query(_OVERALL + " SELECT count(*) AS n, sum((q >= 0.6)::INT)::BIGINT AS successful, round(avg(q), 6) AS mean_quality, round(stddev_pop(q), 6) AS std_quality, round(avg(n), 6) AS mean_length, round(corr(n, q), 6) AS correlation, arg_max(episode_index, (q, -episode_index)) AS best_episode, round(sum((q >= 0.6)::INT) / count(*), 6)::DOUBLE AS success_rate, CASE WHEN 100*sum((q >= 0.6)::INT)/count(*) >= 70 THEN 'high' WHEN 100*sum((q >= 0.6)::INT)/count(*) >= 50 THEN 'medium' ELSE 'low' END AS level FROM ob")
def success_indicators(spark, d):
    rows = success.success_indicators(_real_scores(spark, d))
    return rows.select("n", "successful", r("mean_quality"), r("std_quality"), r("mean_length"), r("correlation"), "best_episode", r("success_rate"), "level")


@query(SCORES + " SELECT count(*) AS n, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std, min(q) AS min, max(q) AS max, round(quantile_cont(q, 0.5), 6) AS median FROM o")
def quality_stats(spark, d):
    return stats.whole_summary(_scores(spark, d), F.col("quality_score")).select("n", r("mean"), r("std"), "min", "max", r("median"))


@query(SCORES + " SELECT episode_idx, CASE WHEN q >= 0.7 THEN 'Healthy' WHEN q >= 0.5 THEN 'Moderate' ELSE 'Needs Attention' END AS health, CASE WHEN 100*q >= 70 THEN 'high' WHEN 100*q >= 50 THEN 'medium' ELSE 'low' END AS success, CASE WHEN q > 0.7 AND length > 50 THEN 'strong' WHEN q > 0.5 THEN 'moderate' ELSE 'weak' END AS spatial, CASE WHEN q > 0.8 AND length > 50 THEN 'strong' WHEN q > 0.6 THEN 'moderate' ELSE 'weak' END AS consistency, CASE WHEN q >= 0.8 THEN 'good' WHEN q >= 0.6 THEN 'fair' ELSE 'weak' END AS bar FROM o")
def labels(spark, d):
    q, more = F.col("quality_score"), F.col("length") > 50
    return _scores(spark, d).select("episode_idx", success.health_label(q).alias("health"), success.success_level(100 * q).alias("success"), success.insight(q, 0.7, 0.5, more).alias("spatial"), success.insight(q, 0.8, 0.6, more).alias("consistency"), success.bar_level(q, 0.8, 0.6).alias("bar"))


@query(CELLS + ", t AS (SELECT count(*) / 48000.0 AS share FROM c) SELECT round(share, 6)::DOUBLE AS share, CASE WHEN share >= 0.5 THEN 'Excellent' WHEN share >= 0.3 THEN 'Good' WHEN share >= 0.15 THEN 'Moderate' ELSE 'Limited' END AS quality FROM t")
def coverage_quality(spark, d):
    return spatial.workspace_coverage(_small(spark, d), BOUNDS).select(r(F.col("coverage_pct") / 100, 6, "share"), "quality")


_NAMES = ["units_score", "hesitation_score", "submovement_score", "jerk_score", "sparc_score", "overall_score"]
_LONG = ", ".join(f"{{'m': '{c}', 's': {c}}}" for c in _NAMES)
SUMMARY = EXECUTION + f", xl AS (SELECT unnest([{_LONG}]) AS z FROM x), xs AS (SELECT z.m AS metric, count(*) AS n, avg(z.s) AS mean, stddev_pop(z.s) AS std, min(z.s) AS min, max(z.s) AS max FROM xl GROUP BY 1)"


@query(SUMMARY + " SELECT metric, n, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(min, 6) + 0.0 AS min, round(max, 6) + 0.0 AS max FROM xs")
def execution_summary(spark, d):
    rows = execution.execution_summary(execution.execution_scores(signal.features(src.events_frames(spark, d), 1.0)))
    return rows.select("metric", "n", r("mean"), r("std"), r("min"), r("max"))


_SPARC = execution_sql.spectral("sp", "so", "s")


@query(DERIVED + f", so AS (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM m), {_SPARC}, sq AS (SELECT k.*, least(greatest((-sparc - 1) / 2, 0), 1) AS z FROM k JOIN sp ON sp.e = k.episode_index) SELECT episode_index, round(z, 6) + 0.0 AS smooth_score, round(0.35/(1+mean_jerk/100) + 0.35*z + 0.15/(1+std_accel/10) + 0.10/(1+std_speed/mean_speed) + 0.05*least(straight/L, 1), 6) AS overall_score FROM sq")
def motion_quality_sparc(spark, d):
    """Motion quality with the spectral smoothness."""
    features = signal.features(src.events_frames(spark, d))
    smooth = execution.execution_scores(features).select("episode_index", F.col("sparc_score").alias("smooth_score"))
    return motion.motion_quality(features, smooth).select("episode_index", r("smooth_score"), r("overall_score"))


def _spatial(spark, d):
    # each part reads the positions, which are numbered and parsed once
    frames = written(_small(spark, d).select("episode_index", "frame_index", "state"), "positions")
    coverage = spatial.workspace_coverage(frames, BOUNDS)
    rows = spatial.spatial(coverage, spatial.start_variance(frames), spatial.position_distribution(frames), spatial.approach_diversity(frames))
    return rows.join(F.broadcast(coverage.select((F.col("coverage_pct") / 100).alias("coverage_share"))))


_SPACE = f"SELECT a.score AS coverage, b.score AS start, c.score AS distribution, d.score AS angle, 0.4*a.score + 0.3*b.score + 0.2*c.score + 0.1*d.score AS overall, a.coverage_pct / 100 AS share FROM ({PARTS['workspace_coverage']}) a, ({PARTS['start_variance']}) b, ({PARTS['position_distribution']}) c, ({PARTS['approach_diversity']}) d"


@query(f"SELECT coverage, start, distribution, angle, round(overall, 4) AS overall_score, round(share, 6) AS coverage_share FROM ({_SPACE})")
def spatial_summary(spark, d):
    return _spatial(spark, d).select(r("coverage"), r("start"), r("distribution"), r("angle"), r("overall_score", 4), r("coverage_share"))


def _report(spark, d):
    scores = execution.execution_scores(signal.features(src.events_frames(spark, d), 1.0))
    whole = consistency.consistency(src.events_frames(spark, d, True)).withColumn("anomaly_share", (1 - F.col("anomaly")) / 5)
    return report.comprehensive(execution.execution_summary(scores), _spatial(spark, d), whole)


_FACTS = f"""
WITH ex AS (SELECT * FROM ({SUMMARY} SELECT metric, mean FROM xs)), sc AS ({_SPACE}), co AS ({RECORDED.format(limits='1.0::DOUBLE')}),
facts AS (SELECT 'execution' AS category, CASE metric WHEN 'units_score' THEN 'movement_units' WHEN 'hesitation_score' THEN 'hesitations' WHEN 'submovement_score' THEN 'submovements' ELSE 'jerk' END AS metric, mean AS score FROM ex WHERE metric IN ('units_score', 'hesitation_score', 'submovement_score', 'jerk_score')
 UNION ALL SELECT 'spatial', 'coverage_limited', overall FROM sc WHERE share < 0.15 UNION ALL SELECT 'spatial', 'coverage_moderate', overall FROM sc WHERE share >= 0.15 AND share < 0.3
 UNION ALL SELECT 'spatial', 'starting_variance', start FROM sc UNION ALL SELECT 'spatial', 'angle_diversity', angle FROM sc
 UNION ALL SELECT 'consistency', 'overall', overall FROM co UNION ALL SELECT 'consistency', 'anomalies', 1 - (1 - an) / 5 FROM co UNION ALL SELECT 'consistency', 'completeness', 1.0 FROM co UNION ALL SELECT 'consistency', 'temporal', te FROM co),
fired AS (SELECT *, CASE WHEN metric IN ('movement_units', 'hesitations', 'submovements') THEN CASE WHEN score < 0.5 THEN 'HIGH' WHEN score < 0.7 THEN 'MEDIUM' END WHEN metric = 'jerk' THEN CASE WHEN score < 0.3 THEN 'HIGH' WHEN score < 0.5 THEN 'MEDIUM' END
 WHEN metric = 'coverage_limited' THEN 'HIGH' WHEN metric = 'coverage_moderate' THEN 'MEDIUM' WHEN metric IN ('starting_variance', 'angle_diversity') THEN CASE WHEN score < 0.4 THEN 'MEDIUM' END
 WHEN metric = 'overall' THEN CASE WHEN score < 0.6 THEN 'HIGH' END WHEN metric = 'temporal' THEN CASE WHEN score < 0.7 THEN 'MEDIUM' END WHEN score < 0.95 THEN 'MEDIUM' END AS priority FROM facts),
told AS (SELECT * FROM (VALUES {", ".join("('" + "', '".join(t.replace("'", "''") for t in (m, *texts[:2])) + "')" for m, texts in report.ADVICE.items())}) t(metric, issue, advice))
"""


@query(_FACTS + "SELECT priority, category, metric, round(score, 4) + 0.0 AS score, issue, advice FROM fired JOIN told USING (metric) WHERE priority IS NOT NULL")
def dataset_report(spark, d):
    """The rules that the dataset's own features fire."""
    return _report(spark, d)[0].select("priority", "category", "metric", r("score", 4), "issue", "advice")


@query(_FACTS + "SELECT category, count(*) AS rules, count(*) FILTER (priority = 'HIGH') AS HIGH, count(*) FILTER (priority = 'MEDIUM') AS MEDIUM, count(*) FILTER (priority = 'LOW') AS LOW, arg_min(metric, (CASE priority WHEN 'HIGH' THEN 0 ELSE 1 END, score, metric)) AS first FROM fired WHERE priority IS NOT NULL GROUP BY category")
def report_by_category(spark, d):
    return report.by_category(_report(spark, d)[0])


@query(_FACTS + "SELECT round(0.4 * (SELECT mean FROM ex WHERE metric = 'overall_score') + 0.3 * (SELECT overall FROM sc) + 0.3 * (SELECT overall FROM co), 4) AS health_score, count(*) FILTER (priority = 'HIGH') AS HIGH, count(*) FILTER (priority = 'MEDIUM') AS MEDIUM, 0 AS LOW FROM fired")
def dataset_health(spark, d):
    return _report(spark, d)[1].select(r("health_score", 4), "HIGH", "MEDIUM", "LOW")


@query(AXES + ", dl AS (SELECT axis, unnest(range(0, 64)) AS dim, unnest(v) AS w, ratio FROM ev), dr AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY -abs(w), dim) - 1 AS place FROM dl) SELECT axis::INTEGER AS axis, place::INTEGER AS place, dim::INTEGER AS dim, round(w, 6) AS loading, round(ratio, 6) AS ratio FROM dr WHERE place < 2")
def embedding_loadings(spark, d):
    """The two numbers that weigh most in each of the vectors' first three principal axes."""
    return spatial.top_loadings(src.embedding_frames(spark, d), "state", rounds=ROUNDS).select("axis", "place", "dim", r("loading"), r("ratio"))


_BOX = ", ".join(f"least(floor((s{k} - min(s{k}) OVER ()) / (max(s{k}) OVER () - min(s{k}) OVER ()) * 25), 24)::INTEGER AS {n}" for k, n in enumerate(("ix", "iy", "iz")))


@query(PROJECTED + f", bx AS (SELECT {_BOX} FROM ps), bv AS (SELECT ix, iy, iz, count(*) AS visits FROM bx GROUP BY ALL) SELECT ix, iy, iz, visits, round((visits - min(visits) OVER ()) / (max(visits) OVER () - min(visits) OVER ()), 6) + 0.0 AS share FROM bv")
def embedding_voxels(spark, d):
    return spatial.pca_voxels(src.embedding_frames(spark, d), rounds=ROUNDS).select("ix", "iy", "iz", "visits", r("share"))
