"""Column expressions over ARRAY<DOUBLE> vectors and ordered signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INFINITY = float("inf")


def in_order() -> WindowSpec:
    """An episode's frames in order."""
    return Window.partitionBy("episode_index").orderBy("frame_index")


def whole_episode() -> WindowSpec:
    return Window.partitionBy("episode_index")


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(total(F.transform(vector, lambda x: x * x)))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(INFINITY))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights of radius int(truncate * sigma + 0.5)."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def ratio(a: Column, b: Column, otherwise: object = None) -> Column:
    """a / b where b is not 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))
