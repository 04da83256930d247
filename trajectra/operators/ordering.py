"""Row numbers and running sums over a whole table, without putting all of it in one task.

The table is cut at quantiles of the order, each part is numbered by itself, and the totals of
the parts before are added.  The cuts may be rough; they only balance the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.sources.tables import written

PARTS = 64
#: Rows that one task may order by itself.
FEW = 100_000


def _parted(rows: DataFrame, by: str) -> tuple[DataFrame, bool]:
    """rows, written once, with the part of `by` (nulls first), and whether there are several parts."""
    rows = written(rows, "ordered")
    if rows.count() <= FEW:
        return rows.withColumn("part_", F.lit(0)), False
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    cuts = sorted(set(rows.agg(F.approx_percentile(by, shares, F.lit(10_000))).first()[0] or []))
    part = sum(((F.col(by) > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    return rows.withColumn("part_", F.coalesce(part, F.lit(-1))), True


def _before(parts: DataFrame, total: Column) -> DataFrame:
    """part_, before_, all_: the totals of the parts before each part, and of all (PARTS + 1 rows at most)."""
    sums = parts.groupBy("part_").agg(total.alias("own_"))
    upto = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.broadcast(sums.withColumns({"before_": F.sum("own_").over(upto) - F.col("own_"), "all_": F.sum("own_").over(Window.partitionBy(F.lit(1)))}).drop("own_"))


def numbered(rows: DataFrame, by: str, name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order of the number column `by` (which has no ties)."""
    parts, several = _parted(rows, by)
    own = F.row_number().over(Window.partitionBy("part_").orderBy(by)) - 1
    if not several:
        return parts.withColumn(name, own.cast("long")).drop("part_")
    return parts.join(_before(parts, F.count("*")), "part_").withColumn(name, (F.col("before_") + own).cast("long")).drop("part_", "before_", "all_")


def running(rows: DataFrame, by: str, x: Column, name: str, whole: str | None = None) -> DataFrame:
    """rows with the sum of x over all rows up to the same `by` (ties count in full), and over all rows."""
    parts, several = _parted(rows, by)
    own = F.sum(x).over(Window.partitionBy("part_").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    if several:
        out = parts.join(_before(parts, F.sum(x)), "part_").withColumn(name, F.col("before_") + own).drop("before_")
    else:
        out = parts.withColumns({name: own, "all_": F.sum(x).over(Window.partitionBy("part_"))})
    return (out.withColumnRenamed("all_", whole) if whole else out.drop("all_")).drop("part_")
