"""Queries over consistency, coverage, success and the report, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.operators import consistency, report, robots, spatial, stats, success
from trajectra.operators.ordering import numbered
from trajectra.plans import axes_sql
from trajectra.plans.motion_queries import EV, LI, r
from trajectra.sources import frames as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _small(spark: SparkSession, d: str) -> DataFrame:
    """Events' states as positions in a cube: (value / 100, k / 100, value * k / 10000)."""
    x, y = F.get("state", F.lit(0)) / 100, F.get("state", F.lit(1)) / 100
    return src.events_frames(spark, d).withColumn("state", F.array(x, y, x * y))


SMALL = EV.replace("CAST(i AS DOUBLE) / 30 AS t", "CAST(i AS DOUBLE) / 30 AS t, x/100 AS px, y/100 AS py, (x/100)*(y/100) AS pz")
CLOCK = "WITH g AS (SELECT user_id AS e, row_number() OVER w - 1 AS i, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 1e6 AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), h AS (SELECT *, t - lag(t) OVER (PARTITION BY e ORDER BY i) AS dt FROM g)"


@query(CLOCK + ", k AS (SELECT *, dt > avg(dt) OVER p + 3 * stddev_pop(dt) OVER p AS jump FROM h WINDOW p AS (PARTITION BY e)), s AS (SELECT e, coalesce(bool_or(dt < 0), false) AS a, coalesce(bool_or(dt = 0), false) AS b, coalesce(bool_or(jump), false) AS c FROM k GROUP BY e) SELECT e AS episode_index, round((CASE WHEN a THEN 0.7 ELSE 1 END) * (CASE WHEN b THEN 0.9 ELSE 1 END) * (CASE WHEN c THEN 0.95 ELSE 1 END), 6)::DOUBLE AS alignment_score, a::INT + b::INT + c::INT AS n_issues FROM s")
def alignment(spark, d):
    return consistency.alignment(src.events_frames(spark, d, True)).select("episode_index", r("alignment_score"), "n_issues")


@query(CLOCK + ", s AS (SELECT e, count(*) AS n, avg(1/(dt+1e-10)) AS fm, stddev_pop(1/(dt+1e-10)) AS fs, stddev_pop(dt) * 30 AS ji, sum((dt > 2/30.0::DOUBLE)::INT) AS dr FROM h GROUP BY e) SELECT e AS episode_index, n, round(CASE WHEN n < 2 THEN 0 ELSE fm END, 6) AS fps_mean, round(CASE WHEN n < 2 THEN 0 ELSE fs END, 6) AS fps_std, round(CASE WHEN n < 2 THEN 0 ELSE ji END, 2) AS jitter, CASE WHEN n < 2 THEN 0 ELSE dr END::BIGINT AS dropouts, round(CASE WHEN n < 2 THEN 0 ELSE 0.6*greatest(1-ji/0.5, 0) + 0.4*greatest(1 - 100.0*dr/(n-1)/10, 0) END, 6)::DOUBLE AS temporal_score FROM s")
def temporal_consistency(spark, d):
    return consistency.temporal(src.events_frames(spark, d, True)).select("episode_index", "n", r("fps_mean"), r("fps_std"), r("jitter", 2), "dropouts", r("temporal_score"))


def _holes(spark, d):
    """Events' frames with NaN where value is below 5, infinity where k is 0, no state where k is 1."""
    x, y = F.get("state", F.lit(0)), F.get("state", F.lit(1))
    state = F.when(y != 1, F.array(F.when(x < 5, F.lit(float("nan"))).otherwise(x), F.when(y == 0, F.lit(float("inf"))).otherwise(y)))
    return src.events_frames(spark, d).withColumn("state", state)


@query(EV + ", s AS (SELECT count(DISTINCT e) AS episodes, count(*) AS n, sum((x < 5 AND y <> 1)::INT) AS nans, sum((y = 0)::INT) AS infs FROM g), c AS (SELECT count(*) AS c FROM (SELECT e FROM g GROUP BY e HAVING sum((y <> 1)::INT) > 0)) SELECT episodes, round(100.0*c/episodes, 6)::DOUBLE AS completeness_pct, round(100.0*nans/n, 6)::DOUBLE AS nan_pct, round(100.0*infs/n, 6)::DOUBLE AS inf_pct, round(0.7*c/episodes + 0.3*greatest(1-(100.0*nans/n+100.0*infs/n)/200, 0), 6)::DOUBLE AS missing_score FROM s, c")
def missing_data(spark, d):
    return consistency.missing(_holes(spark, d)).select("episodes", r("completeness_pct"), r("nan_pct"), r("inf_pct"), r("missing_score"))


@query(EV + " SELECT e AS episode_index, bool_or(y <> 1) AS has_states, true AS has_actions, true AS has_timestamps, coalesce(bool_or(x < 5 AND y <> 1), false) AS nan_states, false AS nan_actions FROM g GROUP BY e")
def presence_matrix(spark, d):
    return consistency.presence(_holes(spark, d))


@query(EV + ", s AS (SELECT e, count(*) AS n, sum((y <> 1)::INT) AS st, bool_or(y <> 1 AND (x < 5 OR y = 0)) AS odd FROM g GROUP BY e) SELECT e AS episode_index, n AS n_frames, st = n AND NOT odd AS valid, concat_ws(',', CASE WHEN st = 0 THEN 'missing_states' END, CASE WHEN st > 0 AND st <> n THEN 'length_mismatch' END, CASE WHEN st > 0 AND odd THEN 'states_not_finite' END) AS issues FROM s")
def validate_episodes(spark, d):
    return consistency.validated(_holes(spark, d))


def _joints(spark, d):
    """Items as six joints: every number scaled to about ±4."""
    s = lambda i, m, w: (F.get("state", F.lit(i)) - m) / w
    return src.lineitem_frames(spark, d).withColumn("state", F.array(s(0, 25.0, 7.0), s(1, 50000.0, 14000.0), s(2, 0.05, 0.0125), s(3, 0.04, 0.0125), s(0, 25.0, 8.0), s(1, 50000.0, 15000.0)))


JOINTS = LI + ", q AS (SELECT e, i, [(a-25)/7, (b-50000)/14000, (c-0.05::DOUBLE)/0.0125::DOUBLE, (d-0.04::DOUBLE)/0.0125::DOUBLE, (a-25)/8, (b-50000)/15000] AS s FROM g)"


@query(JOINTS + f", v AS (SELECT count(*) AS frames, sum((list_max(s) > {math.pi + 0.01!r}::DOUBLE OR list_min(s) < {-math.pi - 0.01!r}::DOUBLE)::INT)::BIGINT AS violations FROM q) SELECT frames, violations, round(100.0*violations/frames, 6)::DOUBLE AS violation_pct, round(greatest(1 - 100.0*violations/frames/10, 0), 6)::DOUBLE AS limit_score FROM v")
def joint_limits(spark, d):
    return consistency.limit_check(_joints(spark, d), "generic_6dof").select("frames", "violations", r("violation_pct"), r("limit_score"))


@query(JOINTS + f", u AS (SELECT unnest(range(0, 6)) AS joint, unnest(s) AS x FROM q) SELECT joint::INTEGER AS joint, sum((x < {-math.pi!r}::DOUBLE)::INT)::BIGINT AS below, sum((x > {math.pi!r}::DOUBLE)::INT)::BIGINT AS above FROM u GROUP BY joint")
def joint_violations(spark, d):
    return consistency.joint_violations(_joints(spark, d), "generic_6dof")


@query(JOINTS + f" SELECT e AS episode_index, i::INTEGER AS frame_index, round(s[1] / {math.pi!r}::DOUBLE, 6) + 0.0 AS unit FROM q")
def normalize_joints(spark, d):
    return _joints(spark, d).select("episode_index", "frame_index", r(F.get(robots.unit_joints(F.col("state"), "generic_6dof"), F.lit(0)), 6, "unit"))


@query(SMALL + " SELECT e AS episode_index, count(*) AS frames, sum((px BETWEEN -0.61 AND 0.61 AND py BETWEEN -0.61 AND 0.61 AND pz BETWEEN -0.01 AND 0.81)::INT)::BIGINT AS inside FROM g GROUP BY e")
def workspace_check(spark, d):
    inside = robots.within_workspace(F.col("state"), "so-arm100").cast("int")
    return _small(spark, d).groupBy("episode_index").agg(F.count("*").alias("frames"), F.sum(inside).alias("inside"))


@query(LI + " SELECT 'lineitem' AS adapter, min(least(a,b,c,d)) AS low, max(greatest(a,b,c,d)) AS high, CASE WHEN min(least(a,b,c,d)) < -10 OR max(greatest(a,b,c,d)) > 10 THEN 'joint' ELSE 'cartesian' END AS space FROM g")
def data_space(spark, d):
    return spatial.data_space(src.lineitem_frames(spark, d)).select(F.lit("lineitem").alias("adapter"), "low", "high", "space")


CELLS = SMALL + ", c AS (SELECT least(floor((px+1)/2*40), 39)::INT AS ix, least(floor((py+1)/2*40), 39)::INT AS iy, least(floor((pz-0)/1.5*30), 29)::INT AS iz, count(*) AS v FROM g WHERE px BETWEEN -1 AND 1 AND py BETWEEN -1 AND 1 AND pz BETWEEN 0 AND 1.5 GROUP BY ALL)"
BOUNDS = robots.ROBOTS["generic_6dof"]["bounds"]


@query(CELLS + " SELECT ix, iy, iz, v AS visits FROM c")
def voxels(spark, d):
    return spatial.voxels(_small(spark, d), spatial.axes_of(BOUNDS, 0.05))


@query(CELLS + f", p AS (SELECT *, -1+(ix+0.5)*0.05 AS x, -1+(iy+0.5)*0.05 AS y, (iz+0.5)*0.05 AS z FROM c), m AS (SELECT count(*) AS visited, avg(v) AS mv, stddev_pop(v) AS sv, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, max(v) AS xv, sum(x*v)/sum(v) AS cx, sum(y*v)/sum(v) AS cy, sum(z*v)/sum(v) AS cz FROM p), s AS (SELECT sum(sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2)*v) AS mo, sum((v >= q3)::INT)::BIGINT AS hot, sum((v <= q1)::INT)::BIGINT AS cold FROM p, m), t AS (SELECT *, visited*100.0/48000 AS cov, 1/(1+sv/(mv+1e-10)) AS uni, mo/visited AS spread, least(mo/visited/(0.3*{math.sqrt(4 + 4 + 2.25)!r}), 1) AS ss FROM m, s) SELECT visited, xv AS max_visits, round(mv, 6) AS mean_visits, round(q2, 6) AS median_visits, hot AS hotspots, cold AS coldspots, round(cov, 6)::DOUBLE AS coverage_pct, round(uni, 6)::DOUBLE AS uniformity, round(spread, 6)::DOUBLE AS mean_spread, round(0.4*least(ln(1+cov)/ln(51),1)+0.3*uni+0.3*ss, 6)::DOUBLE AS score FROM t")
def workspace_coverage(spark, d):
    rows = spatial.workspace_coverage(_small(spark, d), BOUNDS)
    return rows.select("visited", "max_visits", r("mean_visits"), r("median_visits"), "hotspots", "coldspots", r("coverage_pct"), r("uniformity"), r("mean_spread"), r("score"))


@query("WITH w AS (" + SQL["workspace_coverage"] + ") SELECT unnest(['coverage', 'uniformity', 'score']) AS measure, unnest([round(coverage_pct / 100, 6), uniformity, score]) AS value, unnest([coverage_pct / 100 > 0.5, uniformity > 0.5, score > 0.5]) AS enough FROM w")
def coverage_panel(spark, d):
    """The coverage's measures, and which pass a half."""
    rows = spatial.workspace_coverage(_small(spark, d), BOUNDS)
    facts = F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("value")) for n, c in (("coverage", F.col("coverage_pct") / 100), ("uniformity", F.col("uniformity")), ("score", F.col("score")))])
    return rows.select(F.explode(facts).alias("m")).select("m.measure", r("m.value", 6, "value"), (F.col("m.value") > 0.5).alias("enough"))


_N = "(SELECT count(*) FROM g)"
_BINS = f"greatest(5, least(15, floor(pow(50.0*{_N}, 0.25))::INT))"
_PAD = ", ".join(f"min({c}) - 0.1*(max({c})-min({c})) AS l{c}, max({c}) + 0.1*(max({c})-min({c})) AS h{c}" for c in "abcd")
_AT = ", ".join(f"least(floor(({c}-l{c})/(h{c}-l{c})*nb), nb-1) AS k{c}" for c in "abcd")


@query(LI + f", z AS (SELECT {_PAD}, {_BINS} AS nb FROM g), c AS (SELECT {_AT}, any_value(nb) AS nb, count(*) AS v FROM g, z GROUP BY ka, kb, kc, kd), t AS (SELECT count(*) AS visited, count(*)*100.0/pow(max(nb), 4) AS cov, 1/(1+stddev_pop(v)/(avg(v)+1e-10)) AS uni FROM (SELECT ka, kb, kc, kd, nb, v FROM c)) SELECT visited, round(cov, 6)::DOUBLE AS coverage_pct, round(uni, 6)::DOUBLE AS uniformity, round(0.6*least(ln(1+cov)/ln(51),1)+0.4*uni, 6)::DOUBLE AS score FROM t")
def joint_coverage(spark, d):
    return spatial.joint_coverage(src.lineitem_frames(spark, d)).select("visited", r("coverage_pct"), r("uniformity"), r("score"))


@query(SMALL + ", s AS (SELECT px, py, pz FROM g WHERE i = 0) SELECT round(var_pop(px)+var_pop(py)+var_pop(pz), 6) AS total_variance, round((var_pop(px)+var_pop(py)+var_pop(pz))/3, 6) AS mean_variance, round(least((var_pop(px)+var_pop(py)+var_pop(pz))/0.5, 1), 6) AS score FROM s")
def start_variance(spark, d):
    return spatial.start_variance(_small(spark, d)).select(r("total_variance"), r("mean_variance"), r("score"))


@query(SMALL + ", n AS (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM g), l AS (SELECT * FROM n WHERE n >= 5 AND i >= n - greatest(floor(n*0.2), 5)), d AS (SELECT e, count(*)-1 AS m, max_by(px,i)-min_by(px,i) AS x, max_by(py,i)-min_by(py,i) AS y, max_by(pz,i)-min_by(pz,i) AS z FROM l GROUP BY e), u AS (SELECT e, x/m AS x, y/m AS y, z/m AS z FROM d WHERE sqrt((x/m)**2+(y/m)**2+(z/m)**2) > 1e-6) SELECT e AS episode_index, round(atan2(y, x), 5) + 0.0 AS azimuth, round(atan2(z, sqrt(x*x+y*y)), 5) + 0.0 AS elevation FROM u")
def approach_angles(spark, d):
    x, y, z = (F.get("direction", F.lit(i)) for i in range(3))
    return spatial.approach_directions(_small(spark, d)).select("episode_index", r(F.atan2(y, x), 5, "azimuth"), r(F.atan2(z, F.sqrt(x * x + y * y)), 5, "elevation"))


_APPROACH = ", n AS (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM g), l AS (SELECT * FROM n WHERE n >= 5 AND i >= n - greatest(floor(n*0.2), 5)), d AS (SELECT e, count(*)-1 AS m, max_by(px,i)-min_by(px,i) AS x, max_by(py,i)-min_by(py,i) AS y, max_by(pz,i)-min_by(pz,i) AS z FROM l GROUP BY e), u AS (SELECT e, x/m AS x, y/m AS y, z/m AS z FROM d WHERE sqrt((x/m)**2+(y/m)**2+(z/m)**2) > 1e-6)"


@query(SMALL + _APPROACH + ", w AS (SELECT 0 AS dim, atan2(y, x) AS v FROM u UNION ALL SELECT 1, atan2(z, sqrt(x*x+y*y)) FROM u), z AS (SELECT dim, min(v) AS a, max(v) AS b, var_pop(v) AS var, count(*) AS n FROM w GROUP BY dim), h AS (SELECT dim, least(floor((v-a)/(b-a)*20), 19) AS bin, count(*) AS c, any_value(n) AS n FROM w JOIN z USING (dim) GROUP BY 1, 2), k AS (SELECT z.dim, r.i, (coalesce(c, 0) / z.n + 1e-10) / (1 + 20e-10) AS p, var FROM z CROSS JOIN range(20) r(i) LEFT JOIN h ON h.dim = z.dim AND h.bin = r.i), t AS (SELECT dim, sum(-p * ln(p)) AS entropy, any_value(var) AS var FROM k GROUP BY dim) SELECT round(avg(var), 6) AS angle_variance, round(avg(entropy), 6) AS entropy, round(least(avg(entropy)/ln(20), 1), 6) AS score FROM t")
def approach_diversity(spark, d):
    return spatial.approach_diversity(_small(spark, d)).select(r("angle_variance"), r("entropy"), r("score"))


@query(SMALL + ", o AS (SELECT *, row_number() OVER (ORDER BY e, i) - 1 AS k, count(*) OVER () AS n FROM g), s AS (SELECT * FROM o WHERE k IN (SELECT floor(u * ((SELECT max(n) FROM o) - 1) / 999.0)::BIGINT FROM range(1000) r(u))), p AS (SELECT sqrt((a.px-b.px)**2+(a.py-b.py)**2+(a.pz-b.pz)**2) AS d FROM s a JOIN s b ON a.k < b.k) SELECT count(*) AS pairs, round(avg(d), 4) AS mean_distance, round(stddev_pop(d), 4) AS std_distance FROM p")
def pair_distances(spark, d):
    return spatial.pair_distances(_small(spark, d)).select("pairs", r("mean_distance", 4), r("std_distance", 4))


_PAIRS = SMALL.replace("WITH f", "WITH RECURSIVE f") + ", o AS (SELECT *, row_number() OVER (ORDER BY e, i) - 1 AS k, count(*) OVER () AS n FROM g), s AS (SELECT * FROM o WHERE k IN (SELECT floor(u * ((SELECT max(n) FROM o) - 1) / 999.0)::BIGINT FROM range(1000) r(u))), p AS (SELECT count(*) AS pairs, avg(sqrt((a.px-b.px)**2+(a.py-b.py)**2+(a.pz-b.pz)**2)) AS m FROM s a JOIN s b ON a.k < b.k), h AS (SELECT [px, py, pz] AS x, min(k) AS k FROM o GROUP BY 1), z AS (SELECT ln(var_pop(px)+1e-10)+ln(var_pop(py)+1e-10)+ln(var_pop(pz)+1e-10) AS ent FROM g), c(l) AS (SELECT [arg_min(x, k)] FROM h UNION ALL SELECT list_append(l, n) FROM (SELECT l, arg_min(x, k) AS n FROM c, h, p WHERE list_min(list_transform(l, lambda q: list_distance(q, x))) > m GROUP BY l)), t AS (SELECT max(len(l)) AS clusters FROM c)"


@query(_PAIRS + " SELECT pairs, round(m, 4) AS mean_distance, clusters, round(ent, 4) AS spatial_entropy, round(least(clusters/7.0, 1), 6)::DOUBLE AS score FROM p, z, t")
def position_distribution(spark, d):
    return spatial.position_distribution(_small(spark, d)).select("pairs", r("mean_distance", 4), "clusters", r("spatial_entropy", 4), r("score"))


@query(SMALL + ", z AS (SELECT min(px) x0, max(px) x1, min(py) y0, max(py) y1 FROM g) SELECT least(floor((px-x0)/(x1-x0)*50), 49)::INT AS bx, least(floor((py-y0)/(y1-y0)*50), 49)::INT AS by, count(*) AS count FROM g, z GROUP BY ALL")
def density_2d(spark, d):
    return spatial.density(_small(spark, d))


@query()
def reachable_coverage_seeded(spark, d):
    """Reachable cells from joints drawn by the legacy generator (seed 42)."""
    cells, axes = robots.reachable_voxels(spark, "so-arm100")
    return spatial.reachable_coverage(_small(spark, d), cells, axes).select("reachable", "visited", r("coverage"))


def _kinematics(kind: str) -> str:
    """SQL that multiplies the joints' transforms one after another: columns a..i (rotation), x, y, z."""
    steps = [", k0 AS (SELECT e, i, s, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d, 1.0::DOUBLE AS f, 0.0::DOUBLE AS g, 0.0::DOUBLE AS h, 0.0::DOUBLE AS j, 1.0::DOUBLE AS k, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM q)"]
    for n, (d, a, alpha) in enumerate(robots.robot(kind)["dh"], 1):
        ca, sa, d_, a_ = (f"({float(v)!r}::DOUBLE)" for v in (math.cos(alpha), math.sin(alpha), d, a))
        c, s = f"cos(s[{n}])", f"sin(s[{n}])"
        column = {0: (c, s, "0"), 1: (f"-{s}*{ca}", f"{c}*{ca}", sa), 2: (f"{s}*{sa}", f"-{c}*{sa}", ca), 3: (f"{a_}*{c}", f"{a_}*{s}", d_)}
        rows = {"abc": "x", "dfg": "y", "hjk": "z"}
        out = []
        for row, place in rows.items():
            term = lambda m: " + ".join(f"{v}*({column[m][t]})" for t, v in enumerate(row))  # noqa: E731,B023
            out += [f"{term(m)} AS {row[m]}" for m in range(3)] + [f"{term(3)} + {place} AS {place}"]
        steps.append(f", k{n} AS (SELECT e, i, s, {', '.join(out)} FROM k{n - 1})")
    return "".join(steps)


@query(JOINTS + _kinematics("generic_6dof") + " SELECT e AS episode_index, i::INTEGER AS frame_index, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM k6")
def forward_kinematics(spark, d):
    rows = robots.forward_kinematics(_joints(spark, d), "generic_6dof")
    return rows.select("episode_index", "frame_index", *[r(F.get("tool", F.lit(i)), 6, c) for i, c in enumerate("xyz")])


_EACH = " UNION ALL ".join(f"SELECT e, i, {n} AS joint, x, y, z FROM k{n}" for n in range(7))


@query(JOINTS + _kinematics("generic_6dof") + f", u AS ({_EACH}), s AS (SELECT *, coalesce(lead(x) OVER w, x) - CASE WHEN joint = 6 THEN lag(x) OVER w ELSE x END AS dx, coalesce(lead(y) OVER w, y) - CASE WHEN joint = 6 THEN lag(y) OVER w ELSE y END AS dy, coalesce(lead(z) OVER w, z) - CASE WHEN joint = 6 THEN lag(z) OVER w ELSE z END AS dz FROM u WINDOW w AS (PARTITION BY e, i ORDER BY joint)), l AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS len FROM s) SELECT e AS episode_index, i::INTEGER AS frame_index, joint::INTEGER AS joint, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(CASE WHEN len > 1e-10 THEN dx/len ELSE 0 END, 5) + 0.0 AS ux, round(CASE WHEN len > 1e-10 THEN dy/len ELSE 0 END, 5) + 0.0 AS uy, round(CASE WHEN len > 1e-10 THEN dz/len ELSE 1 END, 5) + 0.0 AS uz FROM l")
def joint_poses(spark, d):
    rows = robots.joint_poses(_joints(spark, d), "generic_6dof")
    return rows.select("episode_index", "frame_index", "joint", *[r(F.get("position", F.lit(k)), 6, c) for k, c in enumerate("xyz")], *[r(F.get("direction", F.lit(k)), 5, f"u{c}") for k, c in enumerate("xyz")])


def _evenly(kind: str, n: int) -> str:
    """SQL of q(e, i, s): n joint vectors that fill the robot's limits evenly."""
    arm = robots.robot(kind)
    at = [f"(0.5::DOUBLE + {step!r}::DOUBLE * (v + 1))" for step in robots.even_steps(arm["dof"])]
    return f"q AS (SELECT 0 AS e, v AS i, [{', '.join(f'({float(lo)!r})::DOUBLE + {float(hi - lo)!r}::DOUBLE * ({x} - floor({x}))' for x, lo, hi in zip(at, arm['lower'], arm['upper']))}] AS s FROM range({n}) t(v))"


_ENDS = ", ".join(f"min({c}) - 0.05::DOUBLE AS {c}0, max({c}) + 0.05::DOUBLE AS {c}1" for c in "xyz")
_INTO = ", ".join(f"least(floor(({{}}{c} - {c}0) / ({c}1 - {c}0) * n{c}), n{c} - 1) AS i{c}" for c in "xyz")


@query(SMALL + ", " + _evenly("so-arm100", 10_000) + _kinematics("so-arm100") + f", z0 AS (SELECT {_ENDS} FROM k6), z1 AS (SELECT *, floor((x1 - x0) / 0.05::DOUBLE)::INT + 1 AS nx, floor((y1 - y0) / 0.05::DOUBLE)::INT + 1 AS ny, floor((z1 - z0) / 0.05::DOUBLE)::INT + 1 AS nz FROM z0), rc AS (SELECT DISTINCT {_INTO.replace('{}', 'k6.')} FROM k6, z1), vc AS (SELECT DISTINCT {_INTO.replace('{}', 'p')} FROM g, z1 WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 AND pz BETWEEN z0 AND z1), hc AS (SELECT count(*) AS h FROM rc JOIN vc USING (ix, iy, iz)) SELECT (SELECT count(*) FROM rc) AS reachable, h AS visited, round(h / (SELECT count(*) FROM rc), 6) AS coverage FROM hc")
def reachable_coverage(spark, d):
    cells, axes = robots.reachable_cells(spark, "so-arm100")
    return spatial.reachable_coverage(_small(spark, d), cells, axes).select("reachable", "visited", r("coverage"))


_ARMS = ", ".join(f"('{k}', {len(a['lower'])}, {sum(abs(x) + abs(y) for y, x, _ in robots.DH[k])!r}::DOUBLE, {math.prod(hi - lo for lo, hi in a['bounds'])!r}::DOUBLE, {[float(hi) + 0.01 for _, hi in a['bounds']]}, {[float(lo) - 0.01 for lo, _ in a['bounds']]})" for k, a in robots.ROBOTS.items())


@query(SMALL + f", arms AS (SELECT * FROM (VALUES {_ARMS}) t(robot, dof, reach, volume, high, low)) SELECT robot, dof, round(reach, 6) AS reach, round(volume, 6) AS workspace_volume, count(*) AS frames, count(*) FILTER (px BETWEEN low[1] AND high[1] AND py BETWEEN low[2] AND high[2] AND pz BETWEEN low[3] AND high[3]) AS inside, count(*) FILTER (sqrt(px*px + py*py + pz*pz) <= reach) AS in_reach FROM g, arms GROUP BY ALL")
def robots_for_frames(spark, d):
    """For each known robot: how many of the positions lie in its workspace, and within its reach."""
    length = F.sqrt(F.aggregate("state", F.lit(0.0), lambda s, x: s + x * x))
    facts = [F.count("*").alias("frames"), *[F.count_if(robots.within_workspace(F.col("state"), k)).alias(f"inside_{k}") for k in robots.ROBOTS]]
    table = {row["robot"]: row for row in robots.robot_table(spark).collect()}  # a row for each known robot
    facts += [F.count_if(length <= row["reach"]).alias(f"reach_{k}") for k, row in table.items()]
    told = F.array(*[F.struct(F.lit(k).alias("robot"), F.lit(row["dof"]).alias("dof"), F.lit(round(row["reach"], 6)).alias("reach"), F.lit(round(row["workspace_volume"], 6)).alias("workspace_volume"), F.col("frames").alias("frames"), F.col(f"inside_{k}").alias("inside"), F.col(f"reach_{k}").alias("in_reach")) for k, row in table.items()])
    return _small(spark, d).agg(*facts).select(F.explode(told).alias("r")).select("r.*")


@query()
def robot_table(spark, d):
    return robots.robot_table(spark)


#: Rounds of power iteration that define the vectors' axes, in SQL and in Spark.
ROUNDS = 3000
AXES = axes_sql.axes("WITH p AS (SELECT label AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding[1:64]::DOUBLE[] AS x FROM embeddings)", 64, ROUNDS)
_SCORE = "list_dot_product(list_transform(range(1, 65), lambda i: p.x[i] - mean[i]), {}.v)"
PROJECTED = AXES + f", ps AS (SELECT e, i, {', '.join(f'{_SCORE.format(t)} AS s{k}' for k, t in enumerate(('e0', 'e1', 'e2')))} FROM p, pn, ev e0, ev e1, ev e2 WHERE e0.axis = 0 AND e1.axis = 1 AND e2.axis = 2)"


@query(PROJECTED + " SELECT e AS episode_index, i::INTEGER AS frame_index, round(s0, 6) + 0.0 AS pc1, round(s1, 6) + 0.0 AS pc2 FROM ps")
def pca_embeddings(spark, d):
    rows = src.embedding_frames(spark, d)
    return spatial.projected(rows.select("episode_index", "frame_index", "state"), "state", rounds=ROUNDS).select("episode_index", "frame_index", r(F.get("scores", F.lit(0)), 6, "pc1"), r(F.get("scores", F.lit(1)), 6, "pc2"))


_COV = ", ".join(f"coalesce(covar_samp({a}, {b}), 0) AS {a[1]}{b[1]}" for a, b in (("px", "px"), ("py", "py"), ("pz", "pz"), ("px", "py"), ("px", "pz"), ("py", "pz")))
# the eigenvalues of a symmetric 3 x 3 matrix by the trigonometric formula
EIGEN = SMALL + f", s AS (SELECT {_COV} FROM g WHERE i = 0), em AS (SELECT *, (xx+yy+zz)/3 AS m FROM s), ep AS (SELECT *, sqrt(((xx-m)**2+(yy-m)**2+(zz-m)**2+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM em), ed AS (SELECT *, ((xx-m)*((yy-m)*(zz-m)-yz*yz) - xy*(xy*(zz-m)-yz*xz) + xz*(xy*yz-(yy-m)*xz))/(2*p**3) AS w FROM ep), fi AS (SELECT *, acos(least(greatest(w, -1), 1))/3 AS t FROM ed), v AS (SELECT m + 2*p*cos(t) AS e1, m + 2*p*cos(t + 2*pi()/3) AS e3, m FROM fi)"


@query(EIGEN + " SELECT unnest([0, 1, 2])::INTEGER AS rank, unnest([round(e1, 6), round(3*m - e1 - e3, 6), round(e3, 6)]) AS eigenvalue FROM v")
def start_eigenvalues(spark, d):
    values = spatial.start_eigenvalues(_small(spark, d))
    return spark.createDataFrame([(i, float(round(v, 6))) for i, v in enumerate(values)], "rank int, eigenvalue double")


@query(EIGEN + " SELECT unnest([0, 1])::INTEGER AS axis, unnest([round(e1/(3*m), 6), round((3*m - e1 - e3)/(3*m), 6)]) AS ratio FROM v")
def start_pca_ratios(spark, d):
    """Shares of the start poses' variance along their first two principal axes."""
    starts = consistency.first_frames(_small(spark, d))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(spatial.principal_axes(starts, "state")[2])], "axis int, ratio double")


# the axes of the 3 x 3 matrix: a row of it less the eigenvalue, crossed with another, is orthogonal to both
_CROSS = "[xy*yz - xz*(yy-{e}), xz*xy - (xx-{e})*yz, (xx-{e})*(yy-{e}) - xy*xy]"
_LEAD = "list_position(list_transform({v}, lambda z: abs(z)), list_max(list_transform({v}, lambda z: abs(z))))"


@query(EIGEN + f", ax AS (SELECT {_CROSS.format(e='e1')} AS u, {_CROSS.format(e='(3*m - e1 - e3)')} AS w FROM (SELECT fi.*, v.e1, v.e3 FROM fi, v)), an AS (SELECT list_transform(u, lambda z: z * sign(u[{_LEAD.format(v='u')}]) / sqrt(list_dot_product(u, u))) AS u, list_transform(w, lambda z: z * sign(w[{_LEAD.format(v='w')}]) / sqrt(list_dot_product(w, w))) AS w FROM ax), mn AS (SELECT avg(px) AS x0, avg(py) AS y0, avg(pz) AS z0 FROM g WHERE i = 0) SELECT e AS episode_index, round(list_dot_product([px-x0, py-y0, pz-z0], u), 6) + 0.0 AS pc1, round(list_dot_product([px-x0, py-y0, pz-z0], w), 6) + 0.0 AS pc2 FROM g, mn, an WHERE i = 0")
def start_pca_scores(spark, d):
    """Start poses on their first two principal axes."""
    rows = spatial.projected(consistency.first_frames(_small(spark, d)).select("episode_index", "state"), "state")
    return rows.select("episode_index", *[r(F.get("scores", F.lit(k)), 6, f"pc{k + 1}") for k in range(2)])


def _points(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


LOF = "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT least(20, count(*) - 1) AS k FROM p), a AS (SELECT a.id AS a, b.id AS b, list_distance(a.x, b.x) AS d FROM p a JOIN p b ON a.id <> b.id), e AS (SELECT a, b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS z FROM a), n WHERE z <= k), r AS (SELECT a AS b, max(d) AS reach FROM e GROUP BY a), l AS (SELECT a, 1 / (avg(greatest(d, reach)) + 1e-10) AS lrd FROM e JOIN r USING (b) GROUP BY a), f AS (SELECT e.a AS id, avg(o.lrd) / any_value(l.lrd) AS lof FROM e JOIN l o ON o.a = e.b JOIN l ON l.a = e.a GROUP BY e.a)"


@query(LOF + " SELECT id, round(lof, 6) AS lof FROM f")
def local_outliers(spark, d):
    """Local outlier factors of all vectors, with neighbours among all."""
    return consistency.local_outlier_factor(_points(spark, d)).select("id", r("lof"))


@query(LOF + ", q AS (SELECT quantile_cont(-lof, 0.1) AS offset_ FROM f) SELECT id, -lof < offset_ AS anomaly FROM f, q")
def local_anomalies(spark, d):
    return consistency.local_anomalies(_points(spark, d)).select("id", "anomaly")


@query()
def isolation_anomalies(spark, d):
    return consistency.anomalies(consistency.isolation_scores(_points(spark, d))).select("id", r("score"), "anomaly")


# quality of an episode, for the success queries: its mean value over 100, halved when k is high
SCORES = "WITH s AS (SELECT user_id AS e, count(*) AS length, round(avg(value) / 100 + avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 200, 6) AS q FROM events GROUP BY user_id), z AS (SELECT min(q) AS a, max(q) AS b FROM s), o AS (SELECT row_number() OVER (ORDER BY e) - 1 AS episode_idx, length, round((q - a) / (b - a), 6) AS q FROM s, z)"


def _scores(spark, d):
    x, y = F.get("state", F.lit(0)), F.get("state", F.lit(1))
    rows = src.events_frames(spark, d).groupBy("episode_index").agg(F.count("*").alias("length"), F.round(F.avg(x) / 100 + F.avg(y) / 200, 6).alias("q"))
    ends = rows.agg(F.min("q").alias("a"), F.max("q").alias("b"))
    return numbered(rows, "episode_index", "episode_idx").join(F.broadcast(ends)).select("episode_idx", "length", F.round((F.col("q") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)), 6).alias("quality_score"))


@query(SCORES + " SELECT episode_idx, length, q AS quality_score, CASE WHEN q >= 0.75 THEN 'excellent' WHEN q >= 0.6 THEN 'good' WHEN q >= 0.45 THEN 'marginal' ELSE 'poor' END AS classification, q >= 0.6 AS is_successful FROM o")
def classify_episodes(spark, d):
    return success.classified(_scores(spark, d))


@query(SCORES + ", k AS (SELECT CASE WHEN q >= 0.75 THEN 'excellent' WHEN q >= 0.6 THEN 'good' WHEN q >= 0.45 THEN 'marginal' ELSE 'poor' END AS c, q FROM o) SELECT n.c AS classification, (SELECT count(*) FROM k WHERE k.c = n.c) AS count, round(100.0 * (SELECT count(*) FROM k WHERE k.c = n.c) / (SELECT count(*) FROM k), 6)::DOUBLE AS pct, round((SELECT count(*) FROM k WHERE q >= 0.6) / (SELECT count(*) FROM k), 6) AS success_rate FROM (SELECT unnest(['excellent','good','marginal','poor']) AS c) n")
def success_rates(spark, d):
    return success.success_rates(success.classified(_scores(spark, d))).select("classification", "count", r("pct"), r("success_rate"))


@query(SCORES + ", b AS (SELECT 'best' AS side, row_number() OVER (ORDER BY q DESC, episode_idx) AS place, episode_idx, q FROM o UNION ALL SELECT 'worst', row_number() OVER (ORDER BY q, episode_idx DESC), episode_idx, q FROM o) SELECT side, place::INTEGER AS place, episode_idx, q AS quality_score FROM b WHERE place <= 5")
def best_worst(spark, d):
    return success.best_worst(_scores(spark, d))


@query(SCORES + " SELECT count(*) FILTER (q > 0.65) AS excellent, count(*) FILTER (q > 0.45 AND q <= 0.65) AS acceptable, count(*) FILTER (q <= 0.45) AS needs_improvement, arg_max(episode_idx, (q, -episode_idx)) AS best_episode FROM o")
def tier_counts(spark, d):
    return success.tiers(_scores(spark, d))


@query(SCORES + " SELECT round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std, min(length) AS min, max(length) AS max, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.25) AS p25, quantile_cont(length, 0.75) AS p75 FROM o")
def length_stats(spark, d):
    return stats.whole_summary(_scores(spark, d), F.col("length")).select(r("mean"), r("std"), "min", "max", "median", "p25", "p75")


_HIST = ", zz AS (SELECT min({x})::DOUBLE AS a, max({x})::DOUBLE AS b FROM o), c AS (SELECT least(floor(({x}-a)/(b-a)*{n}), {n}-1)::INT AS bin, count(*) AS k FROM o, zz GROUP BY 1) SELECT i::INTEGER AS bin, coalesce(k, 0) AS count, round(a+i*(b-a)/{n}, 6) AS low, round(a+i*(b-a)/{n}+(b-a)/{n}/2, 6) AS centre FROM range({n}) r(i) CROSS JOIN zz LEFT JOIN c ON c.bin = i"


@query(SCORES + _HIST.format(x="length", n=20))
def length_histogram(spark, d):
    return stats.histogram(_scores(spark, d), "length", 20).select("bin", "count", r("low"), r("centre"))


@query(SCORES + _HIST.format(x="q", n=15))
def quality_histogram(spark, d):
    return stats.histogram(_scores(spark, d), "quality_score", 15).select("bin", "count", r("low"), r("centre"))


@query(SCORES + ", c AS (SELECT count(*) AS n, corr(length, q) AS r, regr_slope(q, length) AS slope, regr_intercept(q, length) AS intercept FROM o) SELECT n, round(r, 6) AS r, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' ELSE 'strong' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, round(slope, 8) AS slope, round(intercept, 6) AS intercept FROM c")
def length_quality_corr(spark, d):
    return stats.correlation(_scores(spark, d), "length", "quality_score").select("n", r("r"), "strength", "direction", r("slope", 8), r("intercept"))


@query(SCORES + ", n AS (SELECT greatest(1, count(*) // 10) AS k FROM o), l AS (SELECT episode_idx, 'low_quality' AS i FROM (SELECT *, row_number() OVER (ORDER BY q, episode_idx) AS z FROM o) , n WHERE z <= k UNION ALL SELECT episode_idx, 'anomalies' FROM o WHERE length < 55) SELECT episode_idx, string_agg(i, ',' ORDER BY i) AS issues, count(*) AS n_issues, CASE WHEN count(*) > 1 THEN 'multiple' ELSE 'single' END AS kind FROM l GROUP BY episode_idx")
def problem_episodes(spark, d):
    scores = _scores(spark, d)
    return success.problem_episodes(scores, scores.where("length < 55"))


@query(SCORES + " SELECT q.level, count(*) AS episodes FROM (SELECT CASE WHEN q >= 0.65 THEN 'excellent' WHEN q >= 0.45 THEN 'good' WHEN q >= 0.25 THEN 'moderate' ELSE 'poor' END AS level FROM o) q GROUP BY 1")
def quality_levels(spark, d):
    return _scores(spark, d).groupBy(success.level(F.col("quality_score")).alias("level")).agg(F.count("*").alias("episodes"))


def _metrics(spark, d):
    """Scores for the rules: deciles of the episode scores stand for the metrics."""
    q = F.percentile("quality_score", F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7)]))
    row = _scores(spark, d).agg(q.alias("q"))
    named = [("execution", "movement_units", 0), ("execution", "hesitations", 1), ("execution", "submovements", 2), ("execution", "jerk", 0), ("spatial", "starting_variance", 1), ("consistency", "overall", 2), ("consistency", "completeness", 3)]
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), F.round(F.col("q")[i], 6).alias("score")) for c, m, i in named])).alias("m")).select("m.*")


_QS = SCORES + ", k AS (SELECT round(quantile_cont(q, 0.1), 6) AS a, round(quantile_cont(q, 0.3), 6) AS b, round(quantile_cont(q, 0.5), 6) AS c, round(quantile_cont(q, 0.7), 6) AS d FROM o)"


@query(_QS + ", m AS (SELECT 'execution' AS category, 'movement_units' AS metric, a AS score FROM k UNION ALL SELECT 'execution', 'hesitations', b FROM k UNION ALL SELECT 'execution', 'submovements', c FROM k UNION ALL SELECT 'execution', 'jerk', a FROM k UNION ALL SELECT 'spatial', 'starting_variance', b FROM k UNION ALL SELECT 'consistency', 'overall', c FROM k UNION ALL SELECT 'consistency', 'completeness', d FROM k), h AS (SELECT *, CASE WHEN metric IN ('movement_units','hesitations','submovements') THEN CASE WHEN score < 0.5 THEN 'HIGH' WHEN score < 0.7 THEN 'MEDIUM' END WHEN metric = 'jerk' THEN CASE WHEN score < 0.3 THEN 'HIGH' WHEN score < 0.5 THEN 'MEDIUM' END WHEN metric = 'starting_variance' THEN CASE WHEN score < 0.4 THEN 'MEDIUM' END WHEN metric = 'overall' THEN CASE WHEN score < 0.6 THEN 'HIGH' END ELSE CASE WHEN score < 0.95 THEN 'MEDIUM' END END AS priority FROM m) SELECT priority, category, metric, score FROM h WHERE priority IS NOT NULL")
def rule_report(spark, d):
    return report.recommendations(_metrics(spark, d)).select("priority", "category", "metric", "score")


_RULES = [("spatial", "coverage_limited", "a"), ("spatial", "coverage_moderate", "b"), ("spatial", "starting_variance", "c"), ("spatial", "angle_diversity", "b"), ("consistency", "overall", "d"), ("consistency", "anomalies", "d"), ("consistency", "completeness", "c"), ("consistency", "temporal", "d")]


@query(_QS + ", m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, '{m}' AS metric, {v} AS score FROM k" for c, m, v in _RULES) + ") SELECT CASE WHEN metric IN ('coverage_limited', 'overall') THEN 'HIGH' ELSE 'MEDIUM' END AS priority, category, metric, score FROM m WHERE CASE metric WHEN 'coverage_limited' THEN true WHEN 'coverage_moderate' THEN true WHEN 'starting_variance' THEN score < 0.4 WHEN 'angle_diversity' THEN score < 0.4 WHEN 'overall' THEN score < 0.6 WHEN 'temporal' THEN score < 0.7 ELSE score < 0.95 END")
def rule_report_spaces(spark, d):
    """The rules of coverage and consistency over scores in all their ranges."""
    q = F.percentile("quality_score", F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7)]))
    row = _scores(spark, d).agg(q.alias("q"))
    facts = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), F.round(F.col("q")["abcd".index(v)], 6).alias("score")) for c, m, v in _RULES])
    return report.recommendations(row.select(F.explode(facts).alias("m")).select("m.*")).select("priority", "category", "metric", "score")


@query(_QS + " SELECT round(0.4*b + 0.3*c + 0.3*d, 6) AS health_score FROM k")
def health_score(spark, d):
    q = _metrics(spark, d).where(F.col("metric").isin("hesitations", "overall", "completeness"))
    part = F.when(F.col("metric") == "hesitations", "execution").when(F.col("metric") == "overall", "spatial").otherwise("consistency")
    return report.health(q.select(part.alias("part"), "score")).select(r("health_score"))


# a tenth of the frames lies above the forest's limit, which is a quantile of their scores
RECORDED = f"SELECT *, 0.25*al + 0.25*te + 0.2*mi + 0.2*an + 0.1*li AS overall FROM (SELECT avg(alignment_score) AS al FROM ({SQL['alignment']})), (SELECT avg(temporal_score) AS te FROM ({SQL['temporal_consistency']})), (SELECT 1.0::DOUBLE AS mi, greatest(1 - 100.0*(count(*) - 1 - floor(0.9*(count(*) - 1)))/count(*)/20, 0) AS an FROM events), (SELECT {{limits}} AS li)"
_TOLD = "SELECT round(al, 6) AS alignment, round(te, 5) AS temporal, mi AS missing, round(an, 6) AS anomaly, round(li, 6) AS limits, round(overall, 5) AS overall_score FROM ({})"


def _parts(rows):
    return rows.select(r("alignment"), r("temporal", 5), r("missing"), r("anomaly"), r("limits"), r("overall_score", 5))


@query(_TOLD.format(RECORDED.format(limits="1.0::DOUBLE")))
def consistency_summary(spark, d):
    """Consistency of events by the recorder's clock."""
    return _parts(consistency.consistency(src.events_frames(spark, d, True)))


@query(_TOLD.format(RECORDED.format(limits="(SELECT greatest(1 - 10.0*avg((x > 95 OR k > 9)::INT), 0)::DOUBLE FROM (SELECT value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))")))
def consistency_of_robot(spark, d):
    """Consistency of events taken for a six-joint arm; the first two joints pass their limits where value is above 95 or k above 9."""
    x, y = F.get("state", F.lit(0)), F.get("state", F.lit(1))
    joint = lambda v, most: F.when(v > most, v - most + math.pi + 0.02).otherwise(v * (math.pi / most))
    joints = F.array(joint(x, 95.0), joint(y, 9.0), *[F.lit(0.0)] * 4)
    return _parts(consistency.consistency(src.events_frames(spark, d, True).withColumn("state", joints), kind="generic_6dof"))


@query(LI + " SELECT e AS episode_index, unnest(['0','1','2','3'])::INTEGER AS dim, unnest([round(avg(a),4), round(avg(b),4), round(avg(c),4), round(avg(d),4)]) AS mean, unnest([round(stddev_pop(a),4), round(stddev_pop(b),4), round(stddev_pop(c),4), round(stddev_pop(d),4)]) AS std, unnest([min(a), min(b), min(c), min(d)]) AS min, unnest([max(a), max(b), max(c), max(d)]) AS max FROM g GROUP BY e")
def dimension_stats(spark, d):
    rows = src.lineitem_frames(spark, d).select("episode_index", F.posexplode("state").alias("dim", "x")).where("dim < 6")
    return rows.groupBy("episode_index", "dim").agg(r(F.avg("x"), 4, "mean"), r(F.stddev_pop("x"), 4, "std"), F.min("x").alias("min"), F.max("x").alias("max"))


@query(SMALL + " SELECT unnest([0,1,2])::INTEGER AS dim, unnest([round(quantile_cont(px,0.25),6), round(quantile_cont(py,0.25),6), round(quantile_cont(pz,0.25),6)]) AS p25, unnest([round(quantile_cont(px,0.5),6), round(quantile_cont(py,0.5),6), round(quantile_cont(pz,0.5),6)]) AS median, unnest([round(quantile_cont(px,0.75),6), round(quantile_cont(py,0.75),6), round(quantile_cont(pz,0.75),6)]) AS p75 FROM g WHERE i = 0")
def start_box(spark, d):
    starts = consistency.first_frames(_small(spark, d)).select(F.posexplode("state").alias("dim", "x"))
    return starts.groupBy("dim").agg(*stats.summary(F.col("x"))).select("dim", r("p25"), r("median"), r("p75"))
