"""Exact order statistics of a whole column, without bringing its values into one task.

A quantile sketch gives two values that a wanted rank lies between, most likely; counting the values below,
between and above says for sure where it lies.  That part is narrowed again until it has one
value or few, so a few passes of aggregates serve any number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.functions.vectors import finite
from trajectra.sources.tables import written

#: The sketch's rank error is a share of 1 / ACCURACY of the values.
ACCURACY = 10_000
#: Values that one task may sort at the end.
FEW = 100_000


def at_ranks(rows: DataFrame, x: str | Column, ranks: list[int]) -> list[float | None]:
    """The values of x, as doubles, at ranks (from 0) in rising order, nulls left out; NaN comes last; None beyond the last."""
    values = rows.select((F.col(x) if isinstance(x, str) else x).cast("double").alias("x")).where("x is not null")
    values = written(values, "values") if len(ranks) else values
    good = F.when(finite(F.col("x")), F.col("x"))
    row = values.agg(F.count(good).alias("n"), F.min(good).alias("low"), F.max(good).alias("high"), F.count_if((F.col("x") < 0) & ~finite(F.col("x"))).alias("below"), F.count_if(~F.isnan("x") & (F.col("x") > 0) & ~finite(F.col("x"))).alias("above"), F.count("*").alias("all")).first()
    out: dict[int, float | None] = {}
    open_: dict[int, tuple[float, float, int, int]] = {}  # rank: bounds, rank within them, values within them
    for r in set(ranks):
        own = r - row["below"]
        if not 0 <= r < row["all"]:
            out[r] = None
        elif own < 0:
            out[r] = -math.inf
        elif own >= row["n"]:
            out[r] = math.inf if own < row["n"] + row["above"] else math.nan
        else:
            open_[r] = (row["low"], row["high"], own, row["n"])
    while open_:
        for r, (low, high, _, _) in list(open_.items()):
            if low == high:
                out[r] = low
                del open_[r]
        few = {r: b for r, b in open_.items() if b[3] <= FEW}
        for (low, high), wanted in _by_bounds(few).items():
            inside = values.where(_within(low, high))
            found = inside.agg(F.array_sort(F.collect_list("x")).alias("v")).select(*[F.get("v", F.lit(own)).alias(str(r)) for r, own in wanted]).first()
            for r, _ in wanted:
                out[r] = found[str(r)]
                del open_[r]
        if not open_:
            break
        cuts = values.agg(*[F.array(*[F.approx_percentile(F.when(_within(low, high), F.col("x")), F.lit(min(max(own / n + side, 0.0), 1.0)), F.lit(ACCURACY)) for side in (-2 / ACCURACY, 2 / ACCURACY)]).alias(str(r)) for r, (low, high, own, n) in open_.items()]).first()
        facts = []
        for r, (low, high, _, _) in open_.items():
            x, (a, b) = F.col("x"), cuts[str(r)]
            # the ends stand alone, so that each pass narrows the bounds whatever the sketch says
            parts = [x == low, (x > low) & (x < a), (x > low) & (x >= a) & (x <= b) & (x < high), (x > b) & (x < high), x == high]
            facts += [F.struct(F.count_if(c).alias("n"), F.min(F.when(c, x)).alias("low"), F.max(F.when(c, x)).alias("high")).alias(f"{r}_{k}") for k, c in enumerate(parts)]
        row = values.agg(*facts).first()
        for r, (_, _, own, _) in list(open_.items()):
            for k in range(5):
                part = row[f"{r}_{k}"]
                if own < part["n"]:
                    open_[r] = (part["low"], part["high"], own, part["n"])
                    break
                own -= part["n"]
    return [out[r] for r in ranks]


def _within(low: float, high: float) -> Column:
    return (F.col("x") >= low) & (F.col("x") <= high)


def _by_bounds(open_: dict) -> dict[tuple[float, float], list[tuple[int, int]]]:
    grouped: dict[tuple[float, float], list[tuple[int, int]]] = {}
    for r, (low, high, own, _) in open_.items():
        grouped.setdefault((low, high), []).append((r, own))
    return grouped


def quantiles(rows: DataFrame, x: str | Column, shares: list[float]) -> list[float | None]:
    """The percentiles of x at shares, between neighbours in proportion; None without values."""
    column = (F.col(x) if isinstance(x, str) else x).cast("double")
    n = rows.select(column.alias("x")).where("x is not null").count()
    if not n:
        return [None] * len(shares)
    if n <= FEW:  # as few values as one task may sort: the built-in aggregate, in one job
        return list(rows.agg(F.percentile(column, F.array(*[F.lit(s) for s in shares]))).first()[0])
    places = [s * (n - 1) for s in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, at_ranks(rows, column, ranks)))
    # as the built-in aggregate weighs the two neighbours
    return [value[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * value[math.floor(p)] + (p - math.floor(p)) * value[math.ceil(p)] for p in places]


def lowest(rows: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The k rows that come first by two number columns (no two rows have both in common), as a filter."""
    if k <= 0:
        return rows.limit(0)
    (last,) = at_ranks(rows, by, [k - 1])
    if last is None:
        return rows.where(F.col(by).isNotNull())
    less = rows.where(F.col(by) < last).count()
    (upto,) = at_ranks(rows.where(F.col(by) == last), tie, [k - less - 1])
    return rows.where((F.col(by) < last) | ((F.col(by) == last) & (F.col(tie) <= upto)))
