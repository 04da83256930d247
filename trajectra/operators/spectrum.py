"""The spectral arc length of long signals: a Fourier transform in two steps over Spark.

With N = M1 * M2 frequencies, place i = M2 * i1 + i2 and frequency k = k1 + M1 * k2, the transform is one
over i1 for each i2, a turn by i2 * k1 / N, and one over i2 for each k1.  Each step is a group
of BLOCK columns, so a task holds BLOCK * sqrt(N) numbers; padding zeros are never stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.sources.tables import written

BLOCK = 64


def padded_size(n: int, pad: int = 4) -> int:
    return int(2 ** (np.ceil(np.log2(n)) + pad))


def shape(n: int) -> tuple[int, int, int, int]:
    """(N, M1, M2, columns of a group) for a signal of n numbers."""
    size = padded_size(n)
    m1 = 1 << (size.bit_length() - 1) // 2
    return size, m1, size // m1, min(BLOCK, m1, size // m1)


def arc_lengths(signals: DataFrame) -> DataFrame:
    """episode_index, sparc of signals(episode_index, i, x, n, dt): a number for each place i of the n, dt seconds apart."""
    log = F.ceil(F.log2("n")) + 4
    m2 = F.pow(F.lit(2.0), log - F.floor(log / 2)).cast("long")
    block = F.least(F.lit(BLOCK), F.pow(F.lit(2.0), F.floor(log / 2)).cast("long"))
    rows = signals.withColumn("column", F.floor((F.col("i") % m2) / block))

    def first(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].iloc[0])
        size, m1, m2, block = shape(n)
        at = part["i"].to_numpy()
        begin = int(part["column"].iloc[0]) * block
        x = np.zeros((block, m1))
        x[at % m2 - begin, at // m2] = part["x"].to_numpy()
        k1 = np.arange(m1)
        turn = (np.arange(begin, begin + block)[:, None] * k1) % size
        y = np.fft.fft(x, axis=1) * np.exp(-2j * np.pi / size * turn)
        # each group of k1 also gets the first of the next one, to which its last is a neighbour
        groups = [y[:, np.arange(g, g + block + 1) % m1] for g in range(0, m1, block)]
        return pd.DataFrame({"episode_index": part["episode_index"].iloc[0], "n": n, "dt": part["dt"].iloc[0], "row": range(len(groups)), "column": begin // block, "re": [g.real.ravel() for g in groups], "im": [g.imag.ravel() for g in groups]})

    turned = rows.groupBy("episode_index", "column").applyInPandas(first, "episode_index long, n long, dt double, row long, column long, re array<double>, im array<double>")

    def second(part: pd.DataFrame) -> pd.DataFrame:
        n, row = int(part["n"].iloc[0]), int(part["row"].iloc[0])
        size, m1, m2, block = shape(n)
        x = np.zeros((m2, block + 1), complex)
        for column, re, im in zip(part["column"], part["re"], part["im"]):
            x[column * block : (column + 1) * block] = (np.asarray(re) + 1j * np.asarray(im)).reshape(block, block + 1)
        y = np.abs(np.fft.fft(x, axis=0))
        own, following = y[: m2 // 2, :block], y[: m2 // 2, 1:].copy()
        if (row + 1) * block == m1:  # the next of k1 = M1 - 1 is k1 = 0 of the next k2
            following[:, -1] = y[1 : m2 // 2 + 1, block]
        steps = (following - own).ravel()
        steps = steps[:-1] if (row + 1) * block == m1 else steps  # no frequency follows the last
        return pd.DataFrame({"episode_index": [part["episode_index"].iloc[0]], "n": [n], "dt": [part["dt"].iloc[0]], "row": [row], "total": [own.sum()], "low": [own[0, 0]], "high": [own[-1, -1]], "steps": [steps]})

    parts = written(turned.groupBy("episode_index", "row").applyInPandas(second, "episode_index long, n long, dt double, row long, total double, low double, high double, steps array<double>"), "spectrum")
    whole = parts.groupBy("episode_index").agg(F.sum("total").alias("all"), F.min_by("low", "row").alias("y0"), F.max_by("high", "row").alias("y1"))
    size = F.pow(F.lit(2.0), log)
    unit = 1 / (size * F.when(F.col("dt") > 0, F.col("dt")).otherwise(F.lit(1 / 30)))
    arc = F.aggregate("steps", F.lit(0.0), lambda s, d: s + F.sqrt(F.col("unit") * F.col("unit") + F.pow(d / F.col("all"), F.lit(2))))
    sums = parts.withColumn("unit", unit).withColumn("size", size).join(whole.where("all > 0"), "episode_index").groupBy("episode_index", "unit", "size", "all", "y0", "y1").agg(F.sum(arc).alias("arc"))
    chord = F.hypot(F.col("unit") * (F.col("size") / 2 - 1), (F.col("y1") - F.col("y0")) / F.col("all"))
    return sums.select("episode_index", (-F.col("arc") / chord).alias("sparc"))
