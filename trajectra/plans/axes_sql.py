"""SQL of principal axes: a covariance table and power iteration on three orthogonal vectors."""

from __future__ import annotations


def axes(rows: str, dims: int, rounds: int) -> str:
    """From rows (a WITH clause that ends in p(..., x), x a list of dims numbers) to ax(mean, ev, total): three axes, largest loadings positive.

    ev is a list of (v, ratio); after each product with the covariance matrix the vectors are made orthogonal again.
    """
    span = f"range(1, {dims + 1})"
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    unit = lambda a: f"list_transform({a}, lambda z: z / sqrt({dot(a, a)}))"
    less = lambda a, b: f"list_transform({span}, lambda i: {a}[i] - {dot(a, b)} * {b}[i])"
    times = lambda a: f"list_transform(m, lambda r: list_dot_product(r, {a}))"
    start = ", ".join(f"list_transform({span}, lambda i: CASE WHEN i % 3 = {k} THEN 1.0::DOUBLE ELSE 0.1 * i / {dims} END) AS {c}" for k, c in enumerate("abd"))
    sign = lambda v: f"list_transform({v}, lambda z: z * sign({v}[list_position(list_transform({v}, lambda y: abs(y)), list_max(list_transform({v}, lambda y: abs(y))))]))"
    return f"""{rows.replace('WITH ', 'WITH RECURSIVE ', 1)},
pn AS (SELECT list(v ORDER BY q) AS mean FROM (SELECT q, avg(x[q]) AS v FROM p, (SELECT unnest({span}) AS q) GROUP BY q)),
pc AS (SELECT q, list(v ORDER BY w) AS r FROM (SELECT q, w, covar_pop(x[q], x[w]) AS v FROM p, (SELECT unnest({span}) AS q), (SELECT unnest({span}) AS w) GROUP BY q, w) GROUP BY q),
pm AS (SELECT list(r ORDER BY q) AS m, sum(r[q]) AS total FROM pc),
it(k, a, b, d) AS (SELECT 0 AS k, {start} UNION ALL
 SELECT k + 1, a, b, {unit('d')} FROM (SELECT k, a, b, {less('d', 'b')} AS d FROM (SELECT k, a, {unit('b')} AS b, {less('d', 'a')} AS d FROM (SELECT k, a, {less('b', 'a')} AS b, d FROM (SELECT k, {unit('a')} AS a, b, d FROM (SELECT k, {times('a')} AS a, {times('b')} AS b, {times('d')} AS d FROM it, pm WHERE k < {rounds})))))),
iv AS (SELECT unnest([0, 1, 2]) AS axis, unnest([a, b, d]) AS v FROM it WHERE k = {rounds}),
ev AS (SELECT axis, {sign('v')} AS v, {dot('v', times('v'))} / total AS ratio FROM iv, pm)"""
