"""Local maxima of a signal in an ARRAY<DOUBLE>, as column expressions: flat tops, distance, prominence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def maxima(x: Column) -> Column:
    """Places of local maxima, the middles of flat tops, in one fold; an end of the signal is none."""
    start = F.struct(F.lit(0).alias("from"), F.lit(False).alias("rising"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, i: Column) -> Column:
        now, before = F.get(x, i), F.get(x, i - 1)
        top = F.array(F.floor((s["from"] + i - 1) / 2).cast("int"))
        state = lambda rising, found: F.struct(i.cast("int").alias("from"), F.lit(rising).alias("rising"), found.alias("found"))
        return F.when(now > before, state(True, s["found"])).when(now < before, state(False, F.when(s["rising"], F.concat(s["found"], top)).otherwise(s["found"]))).otherwise(s)

    places = F.when(F.size(x) > 1, F.sequence(F.lit(1), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["found"])


def thinned(x: Column, places: Column, distance: int) -> Column:
    """places without those that lie closer than distance to a higher one (of equal ones, to the later), from the highest down."""
    high = F.array_sort(F.transform(places, lambda p: F.struct((-F.get(x, p)).alias("h"), (-p).alias("p"))))
    kept = F.aggregate(F.transform(high, lambda s: -s["p"]), F.array().cast("array<int>"), lambda kept, p: F.when(F.exists(kept, lambda q: F.abs(q - p) < distance), kept).otherwise(F.concat(kept, F.array(p))))
    return F.array_sort(kept)


def _lows(heights: Column, valleys: Column) -> Column:
    """For each height the least number between the last higher one before it, or the begin, and itself.

    valleys: the least number since the height before.  A fold keeps the heights that nothing
    later exceeds, each with the least number since the one below it on the stack.
    """
    item = "array<struct<h: double, low: double>>"
    start = F.struct(F.array().cast(item).alias("stack"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        gone = F.filter(s["stack"], lambda t: t["h"] <= e["h"])
        low = F.least(e["v"], F.array_min(F.transform(gone, lambda t: t["low"])))
        left = F.filter(s["stack"], lambda t: t["h"] > e["h"])
        return F.struct(F.concat(left, F.array(F.struct(e["h"].alias("h"), low.alias("low")))).alias("stack"), F.concat(s["out"], F.array(low)).alias("out"))

    return F.aggregate(F.arrays_zip(heights.alias("h"), valleys.alias("v")), start, step, lambda s: s["out"])


def with_peaks(rows: DataFrame, x: str, prominence: Column, distance: int = 1, name: str = "peaks") -> DataFrame:
    """rows with name: places of x's maxima, thinned by distance, that x falls from by the prominence on both sides before it rises above them or ends.

    Each step is a column of its own, so that nothing is evaluated for every element of an array again.
    """
    v = F.col(x)
    before = lambda k: F.when(k > 0, F.get("marks_", k - 1)).otherwise(F.lit(0))
    after = lambda k: F.coalesce(F.get("marks_", k + 1), F.size(v) - 1)
    rows = rows.withColumn("places_", maxima(v)).withColumn("depth_", prominence)
    # all maxima lie between the ends, which count as heights too
    marks = F.array_distinct(F.concat(F.array(F.lit(0)), F.col("places_"), F.array(F.size(v) - 1)))
    rows = rows.withColumn("marks_", F.when(F.size(v) > 0, marks).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumns({
        "heights_": F.transform("marks_", lambda p: F.get(v, p)),
        "since_": F.transform("marks_", lambda p, k: F.array_min(F.slice(v, before(k) + 1, p - before(k) + 1))),
        "until_": F.transform("marks_", lambda p, k: F.array_min(F.slice(v, p + 1, after(k) - p + 1))),
        "thin_": thinned(v, F.col("places_"), distance) if distance > 1 else F.col("places_"),
    })
    rows = rows.withColumns({"left_": _lows(F.col("heights_"), F.col("since_")), "right_": _lows(F.reverse("heights_"), F.reverse("until_"))}).withColumn("right_", F.reverse("right_"))
    falls = F.zip_with(F.arrays_zip(F.col("marks_").alias("p"), F.col("heights_").alias("h")), F.arrays_zip(F.col("left_").alias("a"), F.col("right_").alias("b")), lambda t, u: F.when(t["h"] - F.greatest(u["a"], u["b"]) >= F.col("depth_"), t["p"]))
    rows = rows.withColumn("deep_", F.array_compact(falls)).withColumn(name, F.when(F.size(v) > 0, F.array_intersect("thin_", "deep_")).otherwise(F.array().cast("array<int>")))
    return rows.drop("places_", "depth_", "marks_", "heights_", "since_", "until_", "thin_", "left_", "right_", "deep_")
