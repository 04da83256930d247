"""SQL of the execution scores: smoothing, maxima, prominences and the spectrum as common table expressions."""

from __future__ import annotations

from trajectra.functions.vectors import gaussian_kernel


def smoothed(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """`name`: the rows of source(e, i, n, ...) with new columns: (column, sigma) smoothed along each episode, edges reflected."""

    def term(column: str, k: int, weight: float) -> str:
        m = f"((i + {k}) % (2 * n) + 2 * n) % (2 * n)"
        return f"{weight!r} * l_{column}[1 + CASE WHEN {m} < n THEN {m} ELSE 2 * n - 1 - {m} END]"

    made = []
    for new, (column, sigma) in columns.items():
        kernel = gaussian_kernel(sigma)
        r = len(kernel) // 2
        made.append(" + ".join(term(column, k, w) for k, w in zip(range(-r, r + 1), kernel)) + f" AS {new}")
    lists = ", ".join(f"list({c} ORDER BY i) AS l_{c}" for c in {c for c, _ in columns.values()})
    return f"{name}_l AS (SELECT e, {lists} FROM {source} GROUP BY e), {name} AS (SELECT {source}.*, {', '.join(made)} FROM {source} JOIN {name}_l USING (e))"


def derived(name: str, source: str, columns: dict[str, str]) -> str:
    """`name`: the rows of source(e, i, dt, ...) with new columns: the change of a column per second, the first frame's from the second."""
    w = "WINDOW w AS (PARTITION BY e ORDER BY i)"
    raw = ", ".join(f"({c} - lag({c}) OVER w) / dt AS raw_{new}" for new, c in columns.items())
    return f"{name}_r AS (SELECT *, {raw} FROM {source} {w}), {name} AS (SELECT *, {', '.join(f'coalesce(raw_{n}, lead(raw_{n}) OVER w) AS {n}' for n in columns)} FROM {name}_r {w})"


def maxima(name: str, source: str, value: str, limit: str, distance: int) -> str:
    """`name`(e, c): the number of maxima of value in source(e, i, n, ..., and the limit), thinned by distance, at least as prominent as the limit."""
    thin = f"list_reduce(list([p] ORDER BY h DESC, p DESC), lambda a, q: CASE WHEN len(list_filter(a, lambda b: abs(b - q[1]) < {distance})) > 0 THEN a ELSE a || q END)" if distance > 1 else "list(p)"
    return f"""
{name}_f AS (SELECT e, i, n, {value} AS v, {limit} AS lim FROM {source}),
{name}_s AS (SELECT *, sum(new) OVER (PARTITION BY e ORDER BY i) AS g FROM (SELECT *, (v IS DISTINCT FROM lag(v) OVER (PARTITION BY e ORDER BY i))::INT AS new FROM {name}_f)),
{name}_g AS (SELECT e, g, min(i) AS a, max(i) AS b, any_value(v) AS h FROM {name}_s GROUP BY e, g),
{name}_p AS (SELECT e, (a + b) // 2 AS p, h FROM (SELECT *, lag(h) OVER w AS x, lead(h) OVER w AS y FROM {name}_g WINDOW w AS (PARTITION BY e ORDER BY g)) WHERE h > x AND h > y),
{name}_k AS (SELECT e, unnest({thin}) AS p FROM {name}_p GROUP BY e),
{name}_h AS (SELECT k.e, k.p, any_value(p.h) AS h, any_value(f.lim) AS lim, coalesce(max(CASE WHEN f.i < k.p AND f.v > p.h THEN f.i END), -1) AS lo, coalesce(min(CASE WHEN f.i > k.p AND f.v > p.h THEN f.i END), any_value(f.n)) AS hi
 FROM {name}_k k JOIN {name}_p p ON p.e = k.e AND p.p = k.p JOIN {name}_f f ON f.e = k.e GROUP BY k.e, k.p),
{name}_m AS (SELECT h.e, h.p, any_value(h) - greatest(min(CASE WHEN f.i > lo AND f.i <= h.p THEN v END), min(CASE WHEN f.i >= h.p AND f.i < hi THEN v END)) >= any_value(h.lim) AS ok FROM {name}_h h JOIN {name}_f f ON f.e = h.e GROUP BY h.e, h.p),
{name} AS (SELECT e, sum(ok::INT) AS c FROM {name}_m GROUP BY e)"""


def spectral(name: str, source: str, value: str) -> str:
    """`name`(e, sparc) of value in source(e, i, n, t, ...): sums over all frames for each frequency of the padded signal."""
    return f"""
{name}_n AS (SELECT e, any_value(n) AS n, (2 ** (ceil(log2(any_value(n))) + 4))::BIGINT AS size, (max(t) - min(t)) / (any_value(n) - 1) AS dt FROM {source} GROUP BY e HAVING any_value(n) >= 2),
{name}_y AS (SELECT e, k, sqrt(sum({value} * cos(2 * pi() * ((k * i) % size) / size)) ** 2 + sum({value} * sin(2 * pi() * ((k * i) % size) / size)) ** 2) AS y, any_value(1 / (size * CASE WHEN z.dt > 0 THEN z.dt ELSE 1.0 / 30 END)) AS f
 FROM (SELECT *, unnest(range(0, size // 2)) AS k FROM {name}_n) z JOIN {source} USING (e) GROUP BY e, k),
{name}_a AS (SELECT *, sqrt(f * f + ((lead(y) OVER w - y) / sum(y) OVER p) ** 2) AS step, y / sum(y) OVER p AS u FROM {name}_y WINDOW w AS (PARTITION BY e ORDER BY k), p AS (PARTITION BY e)),
{name} AS (SELECT e, -sum(step) / sqrt((any_value(f) * (count(*) - 1)) ** 2 + (arg_max(u, k) - arg_min(u, k)) ** 2) AS sparc FROM {name}_a GROUP BY e)"""


def falling(rate: str, a: float, b: float, c: float) -> str:
    return f"CASE WHEN {rate} <= {a} THEN 1 WHEN {rate} <= {b} THEN 1 - ({rate} - {a}) / ({b} - {a}) * 0.3 WHEN {rate} <= {c} THEN 0.7 - ({rate} - {b}) / ({c} - {b}) * 0.4 ELSE greatest(0.3 - ({rate} - {c}) / {c} * 0.3, 0) END"


def smoothed_derivatives() -> list[str]:
    """Expressions from g(e, i, t, x, y) to d6: velocity, acceleration and jerk, each smoothed before the next."""
    return [
        "d0 AS (SELECT *, t - lag(t) OVER (PARTITION BY e ORDER BY i) AS dt, count(*) OVER (PARTITION BY e) AS n FROM g)",
        derived("d1", "d0", {"rvx": "x", "rvy": "y"}), smoothed("d2", "d1", {"vx": ("rvx", 1.0), "vy": ("rvy", 1.0)}),
        derived("d3", "d2", {"rax": "vx", "ray": "vy"}), smoothed("d4", "d3", {"ax": ("rax", 1.0), "ay": ("ray", 1.0)}),
        derived("d5", "d4", {"rjx": "ax", "rjy": "ay"}), smoothed("d6", "d5", {"jx": ("rjx", 1.0), "jy": ("rjy", 1.0)}),
    ]


def execution(frames: str) -> str:
    """From frames (a WITH clause that ends in g(e, i, t, x, y)) to x(e, ...): counts, rates and scores of every episode."""
    kernel = [
        frames, *smoothed_derivatives(),
        "d7 AS (SELECT e, i, n, t, x, y, sqrt(vx * vx + vy * vy) AS s, sqrt(ax * ax + ay * ay) AS ac, sqrt(jx * jx + jy * jy) AS jo FROM d6)",
        smoothed("d8", "d7", {"s2": ("s", 2.0), "slow": ("s", 1.5), "a2": ("ac", 2.0)}),
        "q AS (SELECT *, 0.05 * max(s2) OVER p AS lim_s, 0.1 * stddev_pop(a2) OVER p AS lim_a, 0.05 * max(slow) OVER p AS moving, abs(sign(lead(slow, 2) OVER w - lead(slow) OVER w) - sign(lead(slow) OVER w - slow)) > 1 AS turn, lead(t) OVER w - t AS ahead, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS step FROM d8 WINDOW p AS (PARTITION BY e), w AS (PARTITION BY e ORDER BY i))",
        maxima("mu", "q", "s2", "lim_s", 5), maxima("up", "q", "a2", "lim_a", 1), maxima("lo", "q", "-a2", "lim_a", 1), spectral("sp", "q", "s"),
        "b AS (SELECT e, max(t) - min(t) AS T, sum(step) AS L, sum(jo * jo * ahead) AS cost, coalesce(sum((turn AND slow > moving)::INT), 0) AS hes FROM q GROUP BY e HAVING any_value(n) >= 2)",
        "c AS (SELECT b.*, coalesce(mu.c, 0) AS units, coalesce(up.c, 0) + coalesce(lo.c, 0) AS subs, sparc, cost * T ** 3 / (L * L) AS nj FROM b LEFT JOIN mu USING (e) LEFT JOIN up ON up.e = b.e LEFT JOIN lo ON lo.e = b.e LEFT JOIN sp ON sp.e = b.e)",
        f"x0 AS (SELECT *, {falling('(units / T)', 1.5, 3, 5)} AS units_score, {falling('(hes / T)', 0.5, 1.5, 3)} AS hesitation_score, CASE WHEN subs / T > 8 THEN greatest(0.3 - (subs / T - 8) / 4 * 0.3, 0) ELSE {falling('(subs / T)', 3, 5, 8)} END AS submovement_score, 1 - cume_dist() OVER (ORDER BY nj) AS jerk_score, coalesce(least(greatest((-sparc - 1) / 2, 0), 1), 0.5) AS sparc_score FROM c)",
        "x AS (SELECT *, 0.30 * units_score + 0.25 * hesitation_score + 0.25 * submovement_score + 0.20 * jerk_score AS overall_score FROM x0)",
    ]
    return ",\n".join(kernel)
