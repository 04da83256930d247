"""Derivatives and smoothing of episodes' states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajectra.functions.vectors import gaussian_kernel, in_order, norm
from trajectra.operators.chunks import SIZE, chunked, lists, numbers, vectors


def with_dt(frames: DataFrame) -> DataFrame:
    """Seconds since the frame before (null for the first); 0 counts as a microsecond."""
    dt = F.col("timestamp") - F.lag("timestamp").over(in_order())
    return frames.withColumn("dt", F.when(dt == 0, F.lit(1e-6)).otherwise(dt))


def derivative(frames: DataFrame, source: str, name: str) -> DataFrame:
    """Backward difference of a vector column per second; the first frame repeats the second's."""
    before = F.lag(source).over(in_order())
    raw = F.zip_with(source, before, lambda a, b: a - b)
    rows = frames.withColumn("raw_", F.when(F.col("dt").isNotNull(), F.transform(raw, lambda d: d / F.col("dt"))))
    return rows.withColumn(name, F.coalesce("raw_", F.lead("raw_").over(in_order()))).drop("raw_")


def smooth_frames(frames: DataFrame, column: str, sigma: float) -> DataFrame:
    """A vector column smoothed along each episode, every dimension by itself.

    The frames within the kernel's radius come from a window; positions beyond an edge reflect
    into the same window, so no episode is gathered into one row.
    """
    weights = gaussian_kernel(sigma)
    r = len(weights) // 2
    near = F.collect_list(F.struct("frame_index", F.col(column).alias("v"))).over(in_order().rowsBetween(-2 * r, 2 * r))
    whole = Window.partitionBy("episode_index")
    rows = frames.withColumns({"near_": near, "n_": F.count("*").over(whole)})
    n, i, first = F.col("n_").cast("int"), F.col("frame_index"), F.col("near_")[0]["frame_index"]

    def at(k: int) -> Column:
        m = F.pmod(i + F.lit(k), 2 * n)
        place = F.when(m < n, m).otherwise(2 * n - 1 - m)
        return F.get(F.col("near_"), place - first)["v"]

    def term(k: int, weight: float) -> Column:
        return F.transform(at(k), lambda x: x * F.lit(weight))

    terms = [term(k, w) for k, w in zip(range(-r, r + 1), weights)]
    out = terms[0]
    for following in terms[1:]:
        out = F.zip_with(out, following, lambda a, b: a + b)
    return rows.withColumn(column, out).drop("near_", "n_")


DERIVATIVES = ("velocity", "acceleration", "jerk")


def features(frames: DataFrame, sigma: float = 0.0, size: int = SIZE) -> DataFrame:
    """frames with velocity, acceleration and jerk; each derivative is smoothed before the next.

    Without smoothing these are window expressions; with it each chunk of an episode goes
    through numpy once, so that three smoothed derivatives take one shuffle.
    """
    if sigma <= 0:
        rows = with_dt(frames)
        for source, name in (("state", "velocity"), ("velocity", "acceleration"), ("acceleration", "jerk")):
            rows = derivative(rows, source, name)
        return rows
    weights = np.array(gaussian_kernel(sigma))
    # a derivative looks one frame back, its smoothing as far as the kernel reaches
    halo = 3 * (1 + len(weights) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            episode, own, frame, time, state = (batch.column(n) for n in ("episode_index", "own", "frame_index", "timestamp", "state"))
            for k in range(batch.num_rows):
                x, t, kept = vectors(state, k), numbers(time, k), numbers(own, k).astype(bool)
                dt = np.diff(t)
                dt = np.where(dt == 0, 1e-6, dt)[:, None]
                out = [x]
                for _ in range(3):
                    change = np.diff(out[-1], axis=0) / dt
                    out.append(smoothed_array(np.concatenate([change[:1], change]), weights) if len(change) else np.full_like(x, np.nan))
                columns = [pa.array(np.full(int(kept.sum()), episode[k].as_py())), pa.array(numbers(frame, k)[kept]), pa.array(t[kept]), *[lists(np.ascontiguousarray(v[kept])) for v in out]]
                yield pa.RecordBatch.from_arrays(columns, names=["episode_index", "frame_index", "timestamp", "state", *DERIVATIVES])

    kinds = frames.select("episode_index", "frame_index", "timestamp", "state").schema
    schema = T.StructType([*kinds, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in DERIVATIVES]])
    parts = chunked(frames, {"timestamp": F.col("timestamp"), "state": F.col("state")}, max(size, halo), halo)
    return parts.mapInArrow(run, schema)


def smoothed_array(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x smoothed along its first axis; edges reflect half-sample symmetrically, also past a whole period."""
    r, n = len(weights) // 2, len(x)
    at = np.arange(-r, n + r) % (2 * n)
    padded = x[np.where(at < n, at, 2 * n - 1 - at)]
    return sum(w * padded[k : k + n] for k, w in enumerate(weights))


def moving_average(frames: DataFrame, window: int = 5) -> DataFrame:
    """Each dimension's centred moving sum over the window length, with zeros beyond the edges."""
    half = window // 2
    near = F.collect_list("state").over(in_order().rowsBetween(-(window - 1 - half), half))
    sums = F.aggregate("near_", F.transform("state", lambda x: x * 0.0), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return frames.withColumn("near_", near).withColumn("smoothed", F.transform(sums, lambda x: x / window)).drop("near_")


def savgol(frames: DataFrame, window: int = 5, order: int = 3) -> DataFrame:
    """Each dimension's least-squares polynomial over a window; the first and last fit serve the edges.

    An even window grows by one; episodes shorter than the window stay as they are.
    """
    window += window % 2 == 0
    half = window // 2
    base = np.vander(np.arange(window) - half, order + 1, increasing=True).astype(float)
    fit = F.lit([[float(v) for v in row] for row in base @ np.linalg.pinv(base)])
    near = F.collect_list(F.struct("frame_index", F.col("state").alias("v"))).over(in_order().rowsBetween(-(window - 1), window - 1))
    rows = frames.withColumns({"near_": near, "n_": F.count("*").over(Window.partitionBy("episode_index")), "i_": F.row_number().over(in_order()) - 1})
    n, i = F.col("n_").cast("int"), F.col("i_")
    start = F.least(F.greatest(i - half, F.lit(0)), n - window)
    begin = start - F.greatest(i - (window - 1), F.lit(0))  # of the fit, among the frames near
    weights = F.get(fit, i - start)

    def term(j: int) -> Column:
        return F.transform(F.get(F.col("near_"), begin + j)["v"], lambda x: x * F.get(weights, F.lit(j)))

    out = term(0)
    for j in range(1, window):
        out = F.zip_with(out, term(j), lambda a, b: a + b)
    return rows.withColumn("smoothed", F.when(n >= window, out).otherwise(F.col("state"))).drop("near_", "n_", "i_")


def smoothed_signal(frames: DataFrame, method: str = "gaussian", window: int = 5, sigma: float = 1.0) -> DataFrame:
    """frames with `smoothed` by gaussian, savgol or moving_average."""
    if method == "gaussian":
        return smooth_frames(frames.withColumn("smoothed", F.col("state")), "smoothed", sigma)
    if method == "savgol":
        return savgol(frames, window)
    if method == "moving_average":
        return moving_average(frames, window)
    raise ValueError(f"method must be gaussian, savgol or moving_average, not {method}")


def path_so_far(frames: DataFrame, share: float = 0.5) -> DataFrame:
    """start, current and end position (three numbers, padded with 0) of each episode, and the frames up to the current."""
    at = F.array(*[F.coalesce(F.get("state", F.lit(d)), F.lit(0.0)) for d in range(3)])
    rows = frames.withColumns({"p": at, "i": F.row_number().over(in_order()) - 1, "n": F.count("*").over(Window.partitionBy("episode_index"))})
    now = F.floor((F.col("n") - 1) * share)
    return rows.groupBy("episode_index").agg(F.min_by("p", "i").alias("start"), F.max(F.when(F.col("i") == now, F.col("p"))).alias("current"), F.max_by("p", "i").alias("end"), F.count_if(F.col("i") <= now).alias("seen"))


def speed_profile(frames: DataFrame) -> DataFrame:
    """Speed between consecutive frames (none for the first); steps of no time take a microsecond."""
    before = F.lag("state").over(in_order())
    dt = F.col("timestamp") - F.lag("timestamp").over(in_order())
    dt = F.when(dt <= 0, F.lit(1e-6)).otherwise(dt)
    speed = norm(F.zip_with("state", before, lambda a, b: a - b)) / dt
    return frames.withColumn("speed", speed).where("speed is not null").select("episode_index", "frame_index", "speed")


def episode_signals(frames: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row per episode with ordered arrays of number columns and of the timestamps."""
    row = F.struct("frame_index", F.col("timestamp").alias("t"), *[c.alias(n) for n, c in columns.items()])
    rows = frames.groupBy("episode_index").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("episode_index", F.col("rows.t").alias("t"), *[F.col(f"rows.{n}").alias(n) for n in columns])
