"""Queries over sources, signals, statistics and motion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectra.functions import peaks
from trajectra.functions.vectors import gaussian_kernel
from trajectra.operators import execution, motion, signal, stats, success
from trajectra.operators.ordering import numbered
from trajectra.plans import execution_sql
from trajectra.sources import frames as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(c, n: int = 6, name: str | None = None):
    """c rounded, without negative zero, under its name."""
    return (F.round(F.col(c) if isinstance(c, str) else c, n) + 0.0).alias(name or c)


# frames of events as e (episode), i (frame), t (seconds), x, y; of items as e, i, t, a, b, c, d
EV = "WITH f AS (SELECT user_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, ts FROM events), g AS (SELECT *, CAST(i AS DOUBLE) / 30 AS t FROM f)"
LI = "WITH f AS (SELECT l_suppkey AS e, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS i, l_quantity AS a, l_extendedprice AS b, l_discount + 0.0::DOUBLE AS c, l_tax + 0.0::DOUBLE AS d FROM lineitem), g AS (SELECT *, CAST(i AS DOUBLE) / 30 AS t FROM f)"
DERIVED = EV + """,
d AS (SELECT *, t - lag(t) OVER w AS dt FROM g WINDOW w AS (PARTITION BY e ORDER BY i)),
v0 AS (SELECT *, (x - lag(x) OVER w) / dt AS p, (y - lag(y) OVER w) / dt AS q FROM d WINDOW w AS (PARTITION BY e ORDER BY i)),
v AS (SELECT * EXCLUDE (p, q), coalesce(p, lead(p) OVER w) AS vx, coalesce(q, lead(q) OVER w) AS vy FROM v0 WINDOW w AS (PARTITION BY e ORDER BY i)),
a0 AS (SELECT *, (vx - lag(vx) OVER w) / dt AS p, (vy - lag(vy) OVER w) / dt AS q FROM v WINDOW w AS (PARTITION BY e ORDER BY i)),
a AS (SELECT * EXCLUDE (p, q), coalesce(p, lead(p) OVER w) AS ax, coalesce(q, lead(q) OVER w) AS ay FROM a0 WINDOW w AS (PARTITION BY e ORDER BY i)),
j0 AS (SELECT *, (ax - lag(ax) OVER w) / dt AS p, (ay - lag(ay) OVER w) / dt AS q FROM a WINDOW w AS (PARTITION BY e ORDER BY i)),
j AS (SELECT * EXCLUDE (p, q), coalesce(p, lead(p) OVER w) AS jx, coalesce(q, lead(q) OVER w) AS jy FROM j0 WINDOW w AS (PARTITION BY e ORDER BY i)),
m AS (SELECT *, sqrt(vx*vx+vy*vy) AS s, sqrt(ax*ax+ay*ay) AS ac, sqrt(jx*jx+jy*jy) AS jo, lead(t) OVER w - t AS ahead, coalesce(sqrt((x-lag(x) OVER w)**2 + (y-lag(y) OVER w)**2), 0) AS step FROM j WINDOW w AS (PARTITION BY e ORDER BY i)),
n AS (SELECT *, ac - lag(ac) OVER w AS dac, avg(jo) OVER p AS jm, stddev_pop(jo) OVER p AS js FROM m WINDOW w AS (PARTITION BY e ORDER BY i), p AS (PARTITION BY e)),
o AS (SELECT *, stddev_pop(dac) OVER (PARTITION BY e) AS ds FROM n),
k AS (SELECT e AS episode_index, count(*) AS n, max(t) - min(t) AS T, sum(step) AS L, sqrt((max_by(x, i) - min_by(x, i))**2 + (max_by(y, i) - min_by(y, i))**2) AS straight,
 avg(jo) AS mean_jerk, coalesce(sum(jo*jo*ahead), 0) AS cost, sum((abs(jo - jm) > 2 * js AND js >= 1e-10)::INT) AS jout,
 stddev_pop(ac) AS std_accel, sqrt(avg(ac*ac)) AS rms_accel, sum((abs(dac) > 3 * ds)::INT) AS jumps,
 avg(s) AS mean_speed, stddev_pop(s) AS std_speed, max(s) AS peak_speed, arg_min(t, (-s, i)) - min(t) AS peak_at FROM o GROUP BY e HAVING count(*) >= 2)
"""


@query("SELECT count(DISTINCT user_id) AS total_episodes, count(*) AS total_frames, 2 AS state_dim, 2 AS action_dim, round(count(*) / count(DISTINCT user_id), 6) AS avg_episode_length FROM events")
def dataset_metadata(spark: SparkSession, d: str) -> DataFrame:
    return src.metadata(src.events_frames(spark, d)).withColumn("avg_episode_length", F.round("avg_episode_length", 6))


@query("WITH c AS (SELECT user_id AS episode_index, count(*) AS length FROM events GROUP BY 1), s AS (SELECT *, (sum(length) OVER (ORDER BY episode_index))::BIGINT AS end_frame FROM c) SELECT episode_index, end_frame - length AS start_frame, end_frame, length FROM s")
def episode_ranges(spark, d):
    return src.episode_ranges(src.events_frames(spark, d))


@query("WITH s AS (SELECT DISTINCT user_id AS e FROM events), k AS (SELECT e FROM s ORDER BY md5('42:' || e), e LIMIT 20) SELECT user_id AS episode_index, count(*) AS frames FROM events WHERE user_id IN (SELECT e FROM k) GROUP BY 1")
def random_sample(spark, d):
    frames = src.events_frames(spark, d)
    return src.restricted(frames, src.sampled_episodes(frames, "random", 20)).groupBy("episode_index").agg(F.count("*").alias("frames"))


@query(EV + " SELECT e AS episode_index, i::INTEGER AS frame_index FROM (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM f) WHERE i % greatest(n // 10, 1) = 0 AND i / greatest(n // 10, 1) < 10")
def camera_subsample(spark, d):
    return src.subsampled(src.events_frames(spark, d), 10).select("episode_index", "frame_index")


@query(EV + ", s AS (SELECT e, i, x, y, coalesce(sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2), 0) AS step FROM g WINDOW w AS (PARTITION BY e ORDER BY i)), p AS (SELECT e AS episode_index, count(*) AS n, sum(step) AS path, sqrt((max_by(x,i)-min_by(x,i))**2+(max_by(y,i)-min_by(y,i))**2) AS straight FROM s GROUP BY e) SELECT episode_index, n, round(path, 6) AS path, round(straight, 6) AS straight, round(CASE WHEN n < 2 OR path < 1e-10 THEN 1 ELSE least(straight/path, 1) END, 6) AS efficiency FROM p ORDER BY efficiency DESC, episode_index LIMIT 5")
def path_efficiency_topk(spark, d):
    rows = motion.path_efficiency(src.events_frames(spark, d))
    return rows.select("episode_index", "n", r("path"), r("straight"), r("efficiency")).orderBy(F.desc("efficiency"), "episode_index").limit(5)


@query(DERIVED + "SELECT e AS episode_index, i::INTEGER AS frame_index, round(vx, 4) + 0.0 AS vx, round(vy, 4) + 0.0 AS vy, round(ax, 3) + 0.0 AS ax, round(ay, 3) + 0.0 AS ay, round(jx, 1) + 0.0 AS jx, round(jy, 1) + 0.0 AS jy FROM j")
def derivatives(spark, d):
    rows = signal.features(src.events_frames(spark, d))
    at = lambda c, k, n, name: r(F.get(c, F.lit(k)), n, name)
    return rows.select("episode_index", "frame_index", at("velocity", 0, 4, "vx"), at("velocity", 1, 4, "vy"), at("acceleration", 0, 3, "ax"), at("acceleration", 1, 3, "ay"), at("jerk", 0, 1, "jx"), at("jerk", 1, 1, "jy"))


SMOOTHED = ", ".join(execution_sql.smoothed_derivatives())


@query(EV + ", " + SMOOTHED + " SELECT e AS episode_index, i::INTEGER AS frame_index, round(vx, 5) + 0.0 AS vx, round(vy, 5) + 0.0 AS vy, round(ax, 4) + 0.0 AS ax, round(ay, 4) + 0.0 AS ay, round(jx, 2) + 0.0 AS jx, round(jy, 2) + 0.0 AS jy FROM d6")
def smoothed_derivatives(spark, d):
    """Velocity, acceleration and jerk, each smoothed (sigma 1) before the next."""
    rows = signal.features(src.events_frames(spark, d), 1.0)
    at = lambda c, k, n, name: r(F.get(c, F.lit(k)), n, name)
    return rows.select("episode_index", "frame_index", *[at(c, k, n, c[0] + "xy"[k]) for c, n in (("velocity", 5), ("acceleration", 4), ("jerk", 2)) for k in range(2)])


_K = gaussian_kernel(1.0)
_TERMS = " + ".join(f"{w!r} * v[1 + (CASE WHEN (((i + {j}) % (2*n)) + 2*n) % (2*n) < n THEN (((i + {j}) % (2*n)) + 2*n) % (2*n) ELSE 2*n - 1 - ((((i + {j}) % (2*n)) + 2*n) % (2*n)) END)]" for j, w in zip(range(-4, 5), _K))


@query(EV + f", l AS (SELECT e, list(x ORDER BY i) AS v, count(*) AS n FROM g GROUP BY e) SELECT g.e AS episode_index, i::INTEGER AS frame_index, round({_TERMS}, 6) + 0.0 AS smoothed FROM g JOIN l ON g.e = l.e")
def gaussian_smooth(spark, d):
    rows = signal.smooth_frames(src.events_frames(spark, d), "state", 1.0)
    return rows.select("episode_index", "frame_index", r(F.get("state", F.lit(0)), 6, "smoothed"))


@query(EV + " SELECT e AS episode_index, i::INTEGER AS frame_index, round(sum(x) OVER (PARTITION BY e ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) + 0.0 AS smoothed FROM g")
def moving_average(spark, d):
    return signal.moving_average(src.events_frames(spark, d)).select("episode_index", "frame_index", r(F.get("smoothed", F.lit(0)), 6, "smoothed"))


@query(EV + ", s AS (SELECT e, i, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2) / (t - lag(t) OVER w) AS s FROM g WINDOW w AS (PARTITION BY e ORDER BY i)) SELECT e AS episode_index, i::INTEGER AS frame_index, round(s, 4) AS speed FROM s WHERE s IS NOT NULL")
def speed_profile(spark, d):
    return signal.speed_profile(src.events_frames(spark, d)).withColumn("speed", F.round("speed", 4))


@query(LI + " SELECT e AS episode_index, i::INTEGER AS frame_index, dim::INTEGER AS dim, round(x, 4) + 0.0 AS value FROM (SELECT e, i, unnest([0,1,2,3]) AS dim, unnest([a,b,c,d]) AS x FROM g)")
def timelines(spark, d):
    rows = src.lineitem_frames(spark, d)
    return rows.select("episode_index", "frame_index", F.posexplode("state").alias("dim", "x")).where("dim < 6").select("episode_index", "frame_index", "dim", r("x", 4, "value"))


@query(LI + " SELECT e AS episode_index, i::INTEGER AS frame_index FROM (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM f) WHERE i % greatest(1, n // 100) = 0 OR i = n - 1")
def animation_frames(spark, d):
    n = F.count("*").over(Window.partitionBy("episode_index"))
    rows = src.lineitem_frames(spark, d).withColumn("n", n)
    return rows.where((F.col("frame_index") % F.greatest(F.lit(1), F.floor(F.col("n") / 100)) == 0) | (F.col("frame_index") == F.col("n") - 1)).select("episode_index", "frame_index")


@query("WITH s AS (SELECT DISTINCT user_id AS e FROM events), n AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, ceil(sqrt(count(*) OVER ()))::BIGINT AS k FROM s) SELECT e AS episode_index, i // k AS row, i % k AS col FROM n")
def grid_layout(spark, d):
    episodes = src.events_frames(spark, d).select("episode_index").distinct()
    k = episodes.agg(F.ceil(F.sqrt(F.count("*"))).alias("k"))
    rows = numbered(episodes, "episode_index", "i").join(F.broadcast(k))
    return rows.select("episode_index", F.floor(F.col("i") / F.col("k")).alias("row"), (F.col("i") % F.col("k")).alias("col"))


@query(EV + " SELECT e AS episode_index, i::INTEGER AS frame_index, round(1 - (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) + 0.0 AS normalised FROM g")
def minmax_normalise(spark, d):
    rows = src.events_frames(spark, d).withColumn("x", F.get("state", F.lit(0)))
    return stats.normalised(rows, "x").select("episode_index", "frame_index", r("normalised"))


@query(EV + " SELECT e AS episode_index, round(sqrt(avg(x*x)), 6) AS rms, round(sum(x*x), 4) AS energy FROM g GROUP BY e")
def rms_energy(spark, d):
    x = F.get("state", F.lit(0))
    return src.events_frames(spark, d).groupBy("episode_index").agg(r(F.sqrt(F.avg(x * x)), 6, "rms"), r(F.sum(x * x), 4, "energy"))


@query(LI + " SELECT e AS episode_index, round(avg(b),4) AS mean, round(stddev_pop(b),4) AS std, min(b) AS min, max(b) AS max, round(quantile_cont(b,0.5),4) AS median, round(quantile_cont(b,0.25),4) AS p25, round(quantile_cont(b,0.75),4) AS p75, round(max(b)-min(b),4) AS range FROM g GROUP BY e")
def stats_summary(spark, d):
    rows = src.lineitem_frames(spark, d).withColumn("b", F.get("state", F.lit(1)))
    return rows.groupBy("episode_index").agg(*stats.summary(F.col("b"))).select("episode_index", r("mean", 4), r("std", 4), "min", "max", r("median", 4), r("p25", 4), r("p75", 4), r("range", 4))


_OUT = "SELECT e AS episode_index, count(*) AS frames, sum(o::INT)::BIGINT AS outliers FROM ({}) GROUP BY e"


def _counted(rows):
    return rows.groupBy("episode_index").agg(F.count("*").alias("frames"), F.sum(F.col("outlier").cast("int")).alias("outliers"))


def _second(spark, d):
    return src.lineitem_frames(spark, d).withColumn("x", F.get("state", F.lit(1)))


@query(LI + _OUT.format("SELECT e, abs(b - avg(b) OVER p) > 2 * stddev_pop(b) OVER p AND stddev_pop(b) OVER p >= 1e-10 AS o FROM g WINDOW p AS (PARTITION BY e)"))
def zscore_outliers(spark, d):
    return _counted(stats.zscore_outliers(_second(spark, d), "x", 2.0))


@query(LI + ", q AS (SELECT e, quantile_cont(b, 0.25) AS q1, quantile_cont(b, 0.75) AS q3 FROM g GROUP BY e)" + _OUT.format("SELECT g.e, b < q1 - 0.5*(q3-q1) OR b > q3 + 0.5*(q3-q1) AS o FROM g JOIN q ON g.e = q.e"))
def iqr_outliers(spark, d):
    return _counted(stats.iqr_outliers(_second(spark, d), "x", 0.5))


@query(LI + _OUT.format("SELECT e, b > avg(b) OVER p + 1.5 * stddev_pop(b) OVER p AS o FROM g WINDOW p AS (PARTITION BY e)"))
def high_outliers(spark, d):
    return _counted(stats.high_outliers(_second(spark, d), "x", 1.5))


@query(LI + ", s AS (SELECT avg(a) am, stddev_pop(a) sa, avg(b) bm, stddev_pop(b) sb, avg(c) cm, stddev_pop(c) sc, avg(d) dm, stddev_pop(d) sd FROM g)" + _OUT.format("SELECT e, abs(a-am) > 1.7*(sa+1e-8) OR abs(b-bm) > 1.7*(sb+1e-8) OR abs(c-cm) > 1.7*(sc+1e-8) OR abs(d-dm) > 1.7*(sd+1e-8) AS o FROM g, s"))
def row_outliers(spark, d):
    return _counted(stats.row_outliers(src.lineitem_frames(spark, d), "zscore", 1.7))


def _gaps(spark, d):
    """Events' first dimension with every frame below 20 taken for missing."""
    x = F.get("state", F.lit(0))
    return src.events_frames(spark, d).withColumn("x", F.when(x >= 20, x))


_GAP = EV + ", h AS (SELECT e, i, CASE WHEN x >= 20 THEN x END AS x, CASE WHEN x >= 20 THEN i END AS k FROM g), w AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS xa, last_value(k IGNORE NULLS) OVER b AS ka, first_value(x IGNORE NULLS) OVER c AS xb, first_value(k IGNORE NULLS) OVER c AS kb FROM h WINDOW b AS (PARTITION BY e ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY e ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(_GAP + " SELECT e AS episode_index, i::INTEGER AS frame_index, round(CASE WHEN ka IS NULL THEN xb WHEN kb IS NULL THEN xa WHEN ka = kb THEN xa ELSE xa + (xb - xa) * (i - ka) / (kb - ka) END, 6) AS filled FROM w")
def fill_interpolate(spark, d):
    return stats.filled(_gaps(spark, d), "x").select("episode_index", "frame_index", r("filled"))


@query(_GAP + " SELECT e AS episode_index, i::INTEGER AS frame_index, round(coalesce(xa, xb), 6) AS filled FROM w")
def fill_forward(spark, d):
    return stats.filled(_gaps(spark, d), "x", "forward_fill").select("episode_index", "frame_index", r("filled"))


@query(_GAP + " SELECT e AS episode_index, count(x) AS kept FROM w WHERE x IS NOT NULL GROUP BY e")
def fill_remove(spark, d):
    return stats.filled(_gaps(spark, d), "x", "remove").groupBy("episode_index").agg(F.count("*").alias("kept"))


_ODD = EV + ", h AS (SELECT e, i, unnest([0, 1]) AS dim, unnest([CASE WHEN x >= 5 THEN x END, CASE WHEN y <> 0 THEN y END]) AS v FROM g), w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS va, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ka, first_value(v IGNORE NULLS) OVER c AS vb, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER c AS kb FROM h WINDOW b AS (PARTITION BY e, dim ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY e, dim ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), v AS (SELECT e, i, dim, v IS NULL AS odd, CASE WHEN ka IS NULL THEN vb WHEN kb IS NULL THEN va WHEN ka = kb THEN va ELSE va + (vb - va) * (i - ka) / (kb - ka) END AS v FROM w)"


def _odd(spark, d):
    """Events' states with NaN where value is below 5 and infinity where k is 0."""
    x, y = F.get("state", F.lit(0)), F.get("state", F.lit(1))
    state = F.array(F.when(x < 5, F.lit(float("nan"))).otherwise(x), F.when(y == 0, F.lit(float("inf"))).otherwise(y))
    return src.events_frames(spark, d).withColumn("state", state)


@query(_ODD + " SELECT e AS episode_index, i::INTEGER AS frame_index, round(max(CASE WHEN dim = 0 THEN v END), 6) AS x, round(max(CASE WHEN dim = 1 THEN v END), 6) AS y, sum(odd::INT)::BIGINT AS repaired FROM v GROUP BY e, i")
def repaired_states(spark, d):
    rows = stats.repaired(_odd(spark, d))
    return rows.select("episode_index", "frame_index", r(F.get("state", F.lit(0)), 6, "x"), r(F.get("state", F.lit(1)), 6, "y"), "repaired")


@query(EV + " SELECT count(*) FILTER (x < 5) + count(*) FILTER (y = 0) AS elements, count(*) FILTER (x >= 5 AND y <> 0) AS kept FROM g")
def repaired_elements(spark, d):
    """Elements that aren't finite, and the frames without any, over all."""
    frames = _odd(spark, d)
    kept = stats.repaired(frames, "remove").agg(F.count("*").alias("kept"))
    return stats.repaired(frames, "forward_fill").agg(F.sum("repaired").alias("elements")).join(F.broadcast(kept))


def _motion(spark, d):
    return motion.episode_metrics(signal.features(src.events_frames(spark, d)))


@query(DERIVED + "SELECT episode_index, n, round(mean_jerk, 0) AS mean_jerk, round(log10(cost + 1), 6) AS log_jerk_cost, jout::BIGINT AS jerk_outliers, round(1/(1+mean_jerk/100), 6) AS jerk_score, round(log10(1 + cost*T**3/(L*L)), 6) AS log_normalised_jerk FROM k")
def jerk_metrics(spark, d):
    m = _motion(spark, d)
    return m.select("episode_index", "n", r("mean_jerk", 0), r(F.log10(F.col("jerk_cost") + 1), 6, "log_jerk_cost"), "jerk_outliers", r("jerk_score"), r(F.log10(1 + F.col("normalised_jerk")), 6, "log_normalised_jerk"))


@query(DERIVED + "SELECT episode_index, round(100.0 * jout / n, 6) AS jerk_outlier_pct, CASE WHEN 100.0 * jout / n > 10 THEN 'weak' WHEN 100.0 * jout / n > 5 THEN 'fair' ELSE 'good' END AS outlier_level, 1/(1+std_speed/mean_speed) > 0.5 AS steady FROM k")
def outlier_levels(spark, d):
    """Bands of the share of jerk outliers, and whether the speed score passes a half."""
    return _motion(spark, d).select("episode_index", r("jerk_outlier_pct"), success.share_level(F.col("jerk_outlier_pct")).alias("outlier_level"), (F.col("speed_score") > 0.5).alias("steady"))


@query(DERIVED + "SELECT episode_index, round(std_accel, 2) AS std_accel, round(rms_accel, 2) AS rms_accel, jumps::BIGINT AS accel_jumps, round(100.0 * jumps / greatest(n - 1, 1), 6) AS accel_jump_pct, round(1/(1+std_accel/10), 6) AS accel_score FROM k")
def acceleration_metrics(spark, d):
    return _motion(spark, d).select("episode_index", r("std_accel", 2), r("rms_accel", 2), "accel_jumps", r("accel_jump_pct"), r("accel_score"))


@query(DERIVED + "SELECT episode_index, round(mean_speed, 4) AS mean_speed, round(std_speed, 4) AS std_speed, round(peak_speed, 4) AS peak_speed, round(peak_at / T, 6) AS time_to_peak, round(1/(1+std_speed/mean_speed), 6) AS speed_score FROM k")
def velocity_metrics(spark, d):
    return _motion(spark, d).select("episode_index", r("mean_speed", 4), r("std_speed", 4), r("peak_speed", 4), r("time_to_peak"), r("speed_score"))


@query(DERIVED + "SELECT episode_index, round(-ln(cost*T**5/(L*L)), 6) AS ldlj, round(least(greatest((-ln(cost*T**5/(L*L)) + 10)/20, 0), 1), 6) AS ldlj_score FROM k")
def ldlj_smoothness(spark, d):
    return _motion(spark, d).select("episode_index", r("ldlj"), r("ldlj_score"))


@query(DERIVED + ", s AS (SELECT episode_index, 0.35/(1+mean_jerk/100) + 0.35*least(greatest((-ln(cost*T**5/(L*L)) + 10)/20, 0), 1) + 0.15/(1+std_accel/10) + 0.10/(1+std_speed/mean_speed) + 0.05*least(straight/L, 1) AS o FROM k) SELECT count(*) AS n_episodes, round(avg(o), 6) AS mean, round(stddev_pop(o), 6) AS std, round(min(o), 6) AS min, round(max(o), 6) AS max FROM s")
def motion_quality_summary(spark, d):
    rows = motion.motion_quality(signal.features(src.events_frames(spark, d)))
    o = F.col("overall_score")
    return rows.agg(F.count("*").alias("n_episodes"), r(F.avg(o), 6, "mean"), r(F.stddev_pop(o), 6, "std"), r(F.min(o), 6, "min"), r(F.max(o), 6, "max"))


@query(DERIVED + ", s AS (SELECT episode_index, round(cost*T**3/(L*L), 0) AS nj FROM k) SELECT episode_index, round(1 - cume_dist() OVER (ORDER BY nj), 6) AS jerk_rank_score FROM s")
def dimensionless_jerk_pct(spark, d):
    rows = motion.jerk_ranks(_motion(spark, d).withColumn("normalised_jerk", F.round("normalised_jerk", 0)))
    return rows.select("episode_index", r("jerk_rank_score"))


EXECUTION = execution_sql.execution(EV)
_SCORES = ["units_score", "hesitation_score", "submovement_score", "jerk_score", "sparc_score", "overall_score"]


@query(EXECUTION + f" SELECT e AS episode_index, units::INTEGER AS movement_units, hes::INTEGER AS hesitations, subs::INTEGER AS submovements, round(sparc, 6) AS sparc, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _SCORES)}, round((hesitation_score + submovement_score) / 2, 6) + 0.0 AS control_confidence FROM x")
def execution_quality(spark, d):
    rows = execution.execution_scores(signal.features(src.events_frames(spark, d), 1.0))
    return rows.select("episode_index", "movement_units", "hesitations", "submovements", r("sparc"), r("units_score"), r("hesitation_score"), r("submovement_score"), r("jerk_score"), r("sparc_score"), r("overall_score"), r("control_confidence"))


@query(EV + ", s AS (SELECT e, list(x ORDER BY i) AS v, count(*) AS n FROM g GROUP BY e), p AS (SELECT e, v, n, unnest(range(0, n - 2)) AS i FROM s WHERE n >= 3) SELECT e AS episode_index, sum((abs(sign(v[i+3]-v[i+2]) - sign(v[i+2]-v[i+1])) > 1 AND v[i+1] > 0.05 * list_max(v))::INT)::INTEGER AS hesitations FROM p GROUP BY e")
def hesitation_count(spark, d):
    """Hesitations of the first dimension taken as a speed, unsmoothed."""
    rows = signal.episode_signals(src.events_frames(spark, d), {"v": F.get("state", F.lit(0))}).where(F.size("v") >= 3)
    return rows.select("episode_index", execution.hesitations(F.col("v")).alias("hesitations"))


_TOPS = execution_sql.maxima("tn", "ts", "x", "lim", 5) + "," + execution_sql.maxima("ta", "ts", "x", "lim", 1)


@query(EV + f", ts AS (SELECT e, i, x, count(*) OVER p AS n, 0.2 * (max(x) OVER p - min(x) OVER p) AS lim FROM g WINDOW p AS (PARTITION BY e)), {_TOPS} SELECT e AS episode_index, coalesce(ta.c, 0)::INTEGER AS tops, coalesce(tn.c, 0)::INTEGER AS apart FROM (SELECT DISTINCT e FROM g) z LEFT JOIN ta USING (e) LEFT JOIN tn USING (e)")
def signal_peaks(spark, d):
    """Maxima of the first dimension that stand out by a fifth of its range, and those of them that are five frames apart, as column expressions."""
    rows = signal.episode_signals(src.events_frames(spark, d), {"v": F.get("state", F.lit(0))})
    depth = 0.2 * (F.array_max("v") - F.array_min("v"))
    rows = peaks.with_peaks(peaks.with_peaks(rows, "v", depth, 1, "tops"), "v", depth, 5, "apart")
    return rows.select("episode_index", F.size("tops").alias("tops"), F.size("apart").alias("apart"))


@query(EV + ", p AS (SELECT e, i, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM g WINDOW w AS (PARTITION BY e ORDER BY i)) SELECT e AS episode_index, count(*) AS extremes FROM p WHERE (x > a AND x > b) OR (x < a AND x < b) GROUP BY e")
def turning_points(spark, d):
    w = Window.partitionBy("episode_index").orderBy("frame_index")
    rows = src.events_frames(spark, d).withColumn("x", F.get("state", F.lit(0))).withColumns({"a": F.lag("x").over(w), "b": F.lead("x").over(w)})
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    return rows.where((x > a) & (x > b) | (x < a) & (x < b)).groupBy("episode_index").agg(F.count("*").alias("extremes"))
