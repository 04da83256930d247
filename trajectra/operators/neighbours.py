"""The nearest neighbours of every row among all rows: an exact join over cells.

Rows belong to the cell of their nearest pivot (a bounded seeded sample of rows).  Each cell
knows its radius, and an upper bound of the distance that its rows' k-th neighbours can have,
from the rows nearest to all pivots.  A row goes as candidate to every cell from which it
isn't too far for that bound, so none is lost.  Cells are compared in blocks of bounded size,
and a row's best candidates of all blocks are merged.

Where the cells rule out so little that this would send more vectors than a comparison of all
rows with all, the rows are one cell, cut into a fixed number of larger blocks: every vector is
then sent as often as there are blocks, however many rows there are, until the blocks
reach their bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.sources.tables import dropped, written

#: Rows for each pivot, and pivots at most; rows of a cell and candidates that meet in one group.
CELL_ROWS, MOST_PIVOTS = 2_000, 512
ROWS, CANDIDATES = 2_048, 8_192
#: Blocks that a table is cut into on either side where cells rule out little, and numbers that such a block may hold.
BLOCKS, BLOCK_NUMBERS = 12, 4_000_000


#: Candidates whose distances give the limit for all of a block.
FIRST = 4_096


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    return np.stack([np.sqrt(((b - row) ** 2).sum(axis=1)) for row in a]) if len(a) else np.zeros((0, len(b)))


def closest(x: np.ndarray, ids: np.ndarray, others: np.ndarray, names: np.ndarray, k: int) -> tuple[list, list]:
    """(distances, ids) of each row's k nearest others, by distance, then id; a row is no neighbour of its own.

    A matrix product tells which can be among them, up to its rounding; those are measured.  The
    first candidates give a limit for all.
    """
    distances, found = [], []
    squares = (others**2).sum(axis=1)
    block = max(16, min(256, (1 << 22) // max(len(others), 1)))
    for at in range(0, len(x), block):
        part = x[at : at + block]
        own = (part**2).sum(axis=1)
        rough = part @ others.T
        rough *= -2
        rough += own[:, None]
        rough += squares
        rough[ids[at : at + block, None] == names[None]] = np.inf
        slack = 1e-12 * (x.shape[1] + 8) * (own + squares.max(initial=0.0))
        first = rough if rough.shape[1] <= 2 * FIRST else rough[:, :FIRST]
        last = min(k, first.shape[1]) - 1
        limit = np.partition(first, last, axis=1)[:, last] + 2 * slack if last >= 0 else np.zeros(len(part))
        for row, r, most in zip(part, rough, limit):
            near = np.flatnonzero(r <= most)
            near = near[np.isfinite(r[near])]
            d = np.sqrt(((others[near] - row) ** 2).sum(axis=1))
            order = np.lexsort((names[near], d))[:k]
            distances.append(d[order])
            found.append(names[near][order])
    return distances, found


def nearest(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """id, near: the k nearest other rows (d, id) of every row of points(id, x), in order; ids are unique, vectors as long and finite."""
    spark = points.sparkSession
    points = written(points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")), "points")
    n = points.count()
    k = min(k, n - 1)
    if k < 1:
        return points.select("id", F.lit(None).cast("array<struct<d: double, id: long>>").alias("near"))
    drawn = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max(1, min(MOST_PIVOTS, n // CELL_ROWS))).select("x").collect()
    pivots = spark.sparkContext.broadcast(np.array([r["x"] for r in drawn], dtype=float))

    def celled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                gap = gaps(np.stack(frame["x"].to_list()).astype(float), pivots.value)
                cell = gap.argmin(axis=1)
                yield frame.assign(cell=cell, gap=gap[np.arange(len(frame)), cell])

    rows = written(points.mapInPandas(celled, "id long, x array<double>, cell long, gap double"), "cells")

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, own in frame.groupby("cell")["gap"]:
                yield pd.DataFrame({"cell": [cell], "n": [len(own)], "radius": [own.max()], "least": [np.sort(own.to_numpy())[: k + 1]]})

    parts = rows.select("cell", "gap").mapInPandas(summed, "cell long, n long, radius double, least array<double>")
    facts = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least")).collect()  # a row per pivot
    m = len(drawn)
    count, radius, least = np.zeros(m, int), np.full(m, -np.inf), [np.zeros(0)] * m
    for f in facts:
        count[f["cell"]], radius[f["cell"]], least[f["cell"]] = f["n"], f["radius"], np.array(f["least"])
    between = gaps(pivots.value, pivots.value)
    bound = np.full(m, -np.inf)
    for i in np.flatnonzero(count):
        # k + 1 rows lie within this of each of the cell's, itself perhaps among them
        bound[i] = np.sort(np.concatenate([radius[i] + between[i, j] + least[j] for j in np.flatnonzero(count)]))[k]
    reach = spark.sparkContext.broadcast((radius + bound) * (1 + 1e-9) + 1e-12)

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                row, cell = np.nonzero(gaps(np.stack(frame["x"].to_list()).astype(float), pivots.value) <= reach.value[None])
                for at in range(0, len(row), 4 * CANDIDATES):
                    yield frame.iloc[row[at : at + 4 * CANDIDATES]].assign(cell=cell[at : at + 4 * CANDIDATES])

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"cell": np.arange(m), "n": (gaps(np.stack(frame["x"].to_list()).astype(float), pivots.value) <= reach.value[None]).sum(axis=0)})

    sizes = {r["cell"]: r["n"] for r in points.select("x").mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # a row per pivot
    cut = [(i, -(-int(count[i]) // ROWS), -(-sizes[i] // CANDIDATES)) for i in range(m) if count[i]]
    most = max(1, min(BLOCK_NUMBERS // max(pivots.value.shape[1], 1), max(ROWS, -(-n // BLOCKS))))
    whole = -(-n // most)
    if sum(sizes[i] * r + int(count[i]) * s for i, r, s in cut) > 2 * n * whole:
        candidates, rows_by_cell, cut = points.withColumn("cell", F.lit(0).cast("long")), rows.withColumn("cell", F.lit(0).cast("long")), [(0, whole, whole)]
    else:
        candidates, rows_by_cell = points.mapInPandas(sent, "id long, x array<double>, cell long"), rows
    blocks = spark.createDataFrame(cut, "cell long, r long, s long")
    split = lambda df, own, others: df.join(F.broadcast(blocks), "cell").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own))).withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
    a, b = split(rows_by_cell.select("id", "x", "cell"), "r", "s"), split(candidates, "s", "r")

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "d": [], "other": []})
        d, other = closest(np.stack(left["x"].to_list()).astype(float), left["id"].to_numpy(), np.stack(right["x"].to_list()).astype(float), right["id"].to_numpy(), k)
        return pd.DataFrame({"id": left["id"], "d": d, "other": other})

    keys = ("cell", "r", "s")
    best = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(compared, "id long, d array<double>, other array<long>")
    pairs = best.select("id", F.zip_with("d", "other", lambda d, o: F.struct(d.alias("d"), o.alias("id"))).alias("near"))
    made = written(pairs.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")), "nearest")
    dropped(points, rows)
    return made


def outlier_factors(points: DataFrame, k: int = 20) -> DataFrame:
    """id, lof: the density of each row's k nearest neighbours among all rows, over its own."""
    near = nearest(points, k)
    long = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.d").alias("d"), F.col("n.id").alias("other"))
    reach = near.select(F.col("id").alias("other"), F.element_at("near", -1)["d"].alias("reach"))
    density = written(long.join(reach, "other").groupBy("id").agg((1 / (F.avg(F.greatest("d", "reach")) + 1e-10)).alias("density")), "density")
    around = long.join(density.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.avg("density").alias("around"))
    factor = F.coalesce(F.col("around") / F.col("density"), F.lit(1.0))  # a row without others is no outlier
    return near.select("id").join(density, "id", "left").join(around, "id", "left").select("id", factor.alias("lof"))
