"""Execution metrics that walk a signal in order: movement units, hesitation, submovements, SPARC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trajectra.functions.vectors import gaussian_kernel, norm
from trajectra.operators import spectrum
from trajectra.operators.chunks import HALO, SIZE, chunked, numbers, vectors
from trajectra.operators.motion import jerk_ranks
from trajectra.operators.signal import smoothed_array
from trajectra.sources.tables import written


def maxima(x: np.ndarray) -> np.ndarray:
    """Places of local maxima: the middles of flat tops."""
    n = len(x)
    turn = np.flatnonzero(np.diff(x) != 0)
    runs = np.concatenate([[0], turn + 1, [n]]) if n else np.zeros(1, int)
    level = x[runs[:-1]] if n else x
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (runs[inner] + runs[inner + 1] - 1) // 2


def thinned(x: np.ndarray, found: np.ndarray, distance: int) -> np.ndarray:
    """The maxima that no higher one lies closer to than distance, taken from the highest down."""
    keep = np.ones(len(found), bool)
    if distance > 1:
        for i in np.argsort(x[found], kind="stable")[::-1]:
            if keep[i]:
                lo, hi = np.searchsorted(found, [found[i] - distance + 1, found[i] + distance])
                keep[lo:hi] = False
                keep[i] = True
    return found[keep]


def falls(x: np.ndarray, p: int, depth: float, step: int) -> bool | None:
    """Whether x falls by depth on one side (step 1 or -1) of the maximum p before it rises above it; None if neither happens."""
    at = p + step
    while 0 <= at < len(x):
        stretch = x[at : at + 64] if step > 0 else x[max(at - 63, 0) : at + 1][::-1]
        out = np.flatnonzero((stretch > x[p]) | (x[p] - stretch >= depth))
        if len(out):
            return bool(stretch[out[0]] <= x[p])
        at += 64 * step
    return None


def peaks(x: np.ndarray, prominence: float, distance: int = 1) -> np.ndarray:
    """Places of local maxima (middles of flat tops), thinned by distance, then by prominence.

    A maximum is prominent if the signal falls by the prominence on both sides before it rises above it.
    """
    found = thinned(x, maxima(x), distance)
    if prominence <= 0:
        return found
    return np.array([p for p in found.tolist() if falls(x, p, prominence, -1) and falls(x, p, prominence, 1)], dtype=int)


def sparc(speed: np.ndarray, dt: float, pad: int = 4) -> float | None:
    """Negated spectral arc length over its chord; the spectrum is scaled by its sum."""
    size = int(2 ** (np.ceil(np.log2(len(speed))) + pad))
    spectrum = np.abs(np.fft.fft(speed, size))[: size // 2]
    total = spectrum.sum()
    if total <= 0 or not np.isfinite(total):
        return None
    y = spectrum / total
    frequency = np.fft.fftfreq(size, dt if dt > 0 else 1 / 30)[: size // 2]
    arc = np.sqrt(np.diff(frequency) ** 2 + np.diff(y) ** 2).sum()
    chord = np.hypot(frequency[-1] - frequency[0], y[-1] - y[0])
    return float(-arc / chord) if chord > 0 else None


#: Signals whose maxima count: column, sign, share of the episode's measure that is the prominence, least distance.
SPEED_SIGMA, SLOW_SIGMA, ACCEL_SIGMA = 2.0, 1.5, 2.0
UNITS, UPPER, LOWER = ("units", "speed", 1, 5), ("upper", "accel", 1, 1), ("lower", "accel", -1, 1)
PROMINENCE = 0.05, 0.1
MOVING = 0.05
_PART = "episode_index long, chunk long, whole boolean, ended boolean, n long, t0 double, t1 double, low double, high double, path double, cost double, fastest double, fastest_slow double, mean double, m2 double, begin int, turns array<double>, raw array<double>, speed array<double>, accel array<double>, movement_units int, hesitations int, submovements int, sparc double"


def _parts(features: DataFrame, size: int, halo: int) -> DataFrame:
    """A row per chunk: sums and signals, and for an episode of one chunk all that is asked of it."""
    wide, narrow = np.array(gaussian_kernel(SPEED_SIGMA)), np.array(gaussian_kernel(SLOW_SIGMA))
    edge = len(wide) // 2
    columns = {"t": F.col("timestamp"), "speed": norm(F.col("velocity")), "accel": norm(F.col("acceleration")), "jolt": norm(F.col("jerk")), "state": F.col("state")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                own, t, raw, accel, jolt = (numbers(batch.column(n), k) for n in ("own", "t", "speed", "accel", "jolt"))
                state, (chunk, frame) = vectors(batch.column("state"), k), (batch.column("chunk")[k].as_py(), numbers(batch.column("frame_index"), k))
                at = np.flatnonzero(own)
                a, b = int(at[0]), int(at[-1]) + 1
                first, last = a == 0, b == len(t)  # no frames beyond: the episode's own ends
                ahead = np.diff(t)
                ahead = np.where(ahead == 0, 1e-6, ahead)
                step = np.sqrt((np.diff(state, axis=0) ** 2).sum(axis=1))
                to = min(b, len(ahead))
                path, cost = float(step[a:to].sum()), float((jolt[:-1] ** 2 * ahead)[a:to].sum())
                speed, slow, accel = smoothed_array(raw, wide), smoothed_array(raw, narrow), smoothed_array(accel, wide)
                turns = np.abs(np.diff(np.sign(np.diff(slow)))) > 1
                turned = slow[a : min(b, len(turns))][turns[a:b]]
                mine = accel[a:b]
                row = [batch.column("episode_index")[k].as_py(), chunk, first and last, last, b - a, float(t[a]), float(t[b - 1]), float(t[a:b].min()), float(t[a:b].max()), path, cost, float(speed[a:b].max()), float(slow[a:b].max()), float(mine.mean()), float(((mine - mine.mean()) ** 2).sum())]
                if first and last:
                    limit = PROMINENCE[1] * accel.std()
                    counts = [len(peaks(speed, PROMINENCE[0] * speed.max(), UNITS[3])), int((turned > MOVING * slow.max()).sum()), len(peaks(accel, limit)) + len(peaks(-accel, limit))]
                    row += [0, None, None, None, None, *counts, sparc(raw, float(np.mean(np.diff(t)))) if len(t) > 1 else None]
                else:
                    # what lies within the kernel's reach of a cut is not as in the whole episode
                    lo, hi = (0 if first else edge), (len(t) if last else len(t) - edge)
                    row += [a - lo, turned, raw[a:b], speed[lo:hi], accel[lo:hi], None, None, None, None]
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    schema = to_arrow_schema(T.StructType.fromDDL(_PART))
    return chunked(features, columns, size, halo).mapInArrow(run, _PART)


def _of_episodes(parts: DataFrame) -> DataFrame:
    """The sums of each episode's chunks."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    variance = (F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean"))) / n - mean * mean
    return parts.groupBy("episode_index").agg(
        n.alias("n"), (F.max_by("t1", "chunk") - F.min_by("t0", "chunk")).alias("duration"), (F.max("high") - F.min("low")).alias("span"), F.sum("path").alias("path"), F.sum("cost").alias("cost"),
        F.max("fastest").alias("fastest"), F.max("fastest_slow").alias("fastest_slow"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("spread"), F.max("chunk").alias("chunks"),
        *[F.sum(c).alias(c) for c in ("movement_units", "hesitations", "submovements", "sparc")],
    )


_FOUND = "episode_index long, chunk long, signal string, sure int, open boolean, low double, high double, asked array<struct<p: int, x: double, left: boolean, right: boolean>>"


def _maxima_of_parts(parts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per chunk and signal: maxima that are surely prominent, those that the chunk can't tell, and whether a flat top or a chain of near maxima goes beyond it."""
    limits = episodes.select("episode_index", F.explode(F.sequence(F.lit(0).cast("long"), "chunks")).alias("chunk"), (PROMINENCE[0] * F.col("fastest")).alias("units"), (PROMINENCE[1] * F.col("spread")).alias("accels"))

    schema = to_arrow_schema(T.StructType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("episode_index", "chunk", "n", "begin", "ended", "units", "accels")}
                begin, first, last = row["begin"], row["chunk"] == 0, row["ended"]
                for name, column, sign, distance in (UNITS, UPPER, LOWER):
                    x, limit = sign * numbers(batch.column(column), k), row["units" if name == "units" else "accels"]
                    found = maxima(x)
                    kept = thinned(x, found, distance)
                    end = begin + row["n"]
                    # a flat stretch or a chain of near maxima that reaches from own frames to a cut can't be told here
                    flat = np.flatnonzero(np.diff(x))
                    lost = (not first and begin >= 0 and (not len(flat) or flat[0] >= begin)) or (not last and (not len(flat) or flat[-1] < end - 1))
                    if distance > 1 and len(found):
                        breaks = np.flatnonzero(np.diff(found) >= distance)
                        lead, tail = found[breaks[0]] if len(breaks) else found[-1], found[breaks[-1] + 1] if len(breaks) else found[0]
                        lost |= (not first and found[0] < distance and lead >= begin) or (not last and found[-1] >= len(x) - distance and tail < end)
                    sure, asked = 0, []
                    for p in kept[(kept >= begin) & (kept < end)].tolist():
                        left = falls(x, p, limit, -1) if limit > 0 else True
                        right = falls(x, p, limit, 1) if limit > 0 and left is not False else left is not False
                        if (left is None and first) or (right is None and last) or left is False or right is False:
                            continue
                        if left and right:
                            sure += 1
                        else:
                            asked.append({"p": p, "x": float(x[p]), "left": left is None, "right": right is None})
                    mine = x[begin:end]
                    out.append((row["episode_index"], row["chunk"], name, sure, bool(lost), float(mine.min()), float(mine.max()), asked))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    return parts.join(limits, ["episode_index", "chunk"]).select("episode_index", "chunk", "n", "begin", "ended", "units", "accels", "speed", "accel").mapInArrow(run, _FOUND)


def _asked(found: DataFrame, parts: DataFrame, episodes: DataFrame) -> DataFrame:
    """episode_index, signal, more: the maxima that other chunks show to be prominent.

    A chunk whose numbers all lie between a maximum and its prominence below tells nothing; the
    ranges of an episode's chunks say which is the nearest one that does.
    """
    limit = F.when(F.col("signal") == "units", PROMINENCE[0] * F.col("fastest")).otherwise(PROMINENCE[1] * F.col("spread"))
    some = found.where(F.size("asked") > 0).select("episode_index", "chunk", "signal", F.explode("asked").alias("a")).join(episodes.select("episode_index", "fastest", "spread"), "episode_index")
    sides = F.array_compact(F.array(F.when(F.col("a.left"), F.lit(-1)), F.when(F.col("a.right"), F.lit(1))))
    some = some.select("episode_index", "chunk", "signal", F.col("a.p").alias("p"), F.col("a.x").alias("x"), limit.alias("limit"), F.explode(sides).alias("side"))
    ranges = found.groupBy("episode_index", "signal").agg(F.array_sort(F.collect_list(F.struct("chunk", "low", "high"))).alias("ranges"))
    telling = lambda r: ((r["high"] > F.col("x")) | (F.col("x") - r["low"] >= F.col("limit")))
    before = F.filter("ranges", lambda r: (r["chunk"] < F.col("chunk")) & telling(r))
    after = F.filter("ranges", lambda r: (r["chunk"] > F.col("chunk")) & telling(r))
    target = F.when(F.col("side") < 0, F.get(before, F.size(before) - 1)["chunk"]).otherwise(F.get(after, F.lit(0))["chunk"])
    some = some.join(ranges, ["episode_index", "signal"]).withColumn("target", target)
    numbers_ = parts.select("episode_index", F.col("chunk").alias("target"), F.slice("speed", F.col("begin") + 1, F.col("n").cast("int")).alias("speed"), F.slice("accel", F.col("begin") + 1, F.col("n").cast("int")).alias("accel"))
    seen = F.when(F.col("signal") == "units", F.col("speed")).when(F.col("signal") == "upper", F.col("accel")).otherwise(F.transform("accel", lambda v: -v))
    out = F.filter(seen, lambda v: (v > F.col("x")) | (F.col("x") - v >= F.col("limit")))
    nearest = F.get(out, F.when(F.col("side") < 0, F.size(out) - 1).otherwise(F.lit(0)))
    told = some.join(numbers_, ["episode_index", "target"], "left").withColumn("falls", F.coalesce(nearest <= F.col("x"), F.lit(False)))
    return told.groupBy("episode_index", "signal", "chunk", "p").agg(F.bool_and("falls").alias("falls")).groupBy("episode_index", "signal").agg(F.count_if("falls").alias("more"))


def rates(features: DataFrame, size: int = SIZE, halo: int = HALO) -> DataFrame:
    """episode_index, n, duration, path, normalised_jerk, movement_units, submovements, hesitations and their rates, sparc.

    An episode of one chunk is measured at once.  The chunks of a longer one give their sums,
    then their maxima by the whole episode's limits; a maximum whose surroundings reach beyond its chunk is
    settled by the nearest chunk that tells, and the spectrum comes from a transform in two
    steps.  Episodes where a flat top or a chain of near maxima crosses a halo take larger chunks.
    """
    parts = written(_parts(features, size, halo), "parts")
    one = _of_episodes(parts.where("whole"))
    long = parts.where("not whole")
    rows = one if long.isEmpty() else one.unionByName(_long(features, long, size, halo))
    moves = (F.col("span") > 0) & (F.col("path") > 0)
    jerk = F.when(moves, F.col("cost") * F.pow("span", F.lit(3)) / F.when(moves, F.col("path") * F.col("path"))).otherwise(F.lit(0.0))
    per_second = lambda c: F.when(F.col("duration") > 0, F.col(c) / F.when(F.col("duration") > 0, F.col("duration"))).otherwise(F.lit(0.0))
    rows = rows.where("n >= 2").select("episode_index", "duration", *[F.col(c).cast("int").alias(c) for c in ("hesitations", "movement_units", "submovements")], "sparc", "n", "path", jerk.alias("normalised_jerk"))
    return rows.withColumns({"unit_rate": per_second("movement_units"), "hesitation_rate": per_second("hesitations"), "submovement_rate": per_second("submovements")})


def _long(features: DataFrame, parts: DataFrame, size: int, halo: int) -> DataFrame:
    """The rows of _of_episodes for episodes of several chunks."""
    sums = written(_of_episodes(parts).drop("movement_units", "hesitations", "submovements", "sparc"), "episodes")
    found = written(_maxima_of_parts(parts, sums), "maxima")
    again = found.where("open").select("episode_index").distinct()
    larger = None
    if not again.isEmpty():
        larger = written(_parts(features.join(again, "episode_index", "left_semi"), 4 * size, 4 * halo), "parts")
        whole, rest = _of_episodes(larger.where("whole")), larger.where("not whole")
        larger = whole if rest.isEmpty() else whole.unionByName(_long(features, rest, 4 * size, 4 * halo))
        parts, sums, found = (df.join(again, "episode_index", "left_anti") for df in (parts, sums, found))
    sure = found.groupBy("episode_index", "signal").agg(F.sum("sure").alias("sure")).join(_asked(found, parts, sums), ["episode_index", "signal"], "left")
    count = F.col("sure") + F.coalesce("more", F.lit(0))
    counts = sure.groupBy("episode_index").agg(F.sum(F.when(F.col("signal") == "units", count)).alias("movement_units"), F.sum(F.when(F.col("signal") != "units", count)).alias("submovements"))
    moving = sums.select("episode_index", F.explode(F.sequence(F.lit(0).cast("long"), "chunks")).alias("chunk"), (MOVING * F.col("fastest_slow")).alias("limit"))
    turns = parts.select("episode_index", "chunk", "turns").join(moving, ["episode_index", "chunk"]).groupBy("episode_index").agg(F.sum(F.size(F.filter("turns", lambda v: v > F.col("limit")))).alias("hesitations"))
    clock = sums.select("episode_index", F.explode(F.sequence(F.lit(0).cast("long"), "chunks")).alias("chunk"), F.col("n").alias("of"), (F.col("duration") / (F.col("n") - 1)).alias("dt"))
    signal = parts.select("episode_index", "chunk", F.posexplode("raw").alias("k", "x")).join(clock, ["episode_index", "chunk"])
    signal = signal.select("episode_index", (F.col("chunk") * size + F.col("k")).alias("i"), "x", F.col("of").alias("n"), "dt")
    made = sums.join(counts, "episode_index").join(turns, "episode_index").join(spectrum.arc_lengths(signal), "episode_index", "left")
    return made if larger is None else made.unionByName(larger, allowMissingColumns=True)


def hesitations(speed: Column) -> Column:
    """Turns of the speed's slope while moving faster than a twentieth of its peak.

    The turn at i compares the slopes after i and after i + 1, and is counted by the speed at i.
    """
    slope = lambda i: F.signum(F.get(speed, i + F.lit(1)) - F.get(speed, i))
    turns = F.filter(F.sequence(F.lit(0), F.greatest(F.size(speed) - 3, F.lit(0))), lambda i: (F.abs(slope(i + F.lit(1)) - slope(i)) > 1) & (F.get(speed, i) > 0.05 * F.array_max(speed)))
    return F.when(F.size(speed) >= 3, F.size(turns)).otherwise(F.lit(0))


def falling(rate: Column, a: float, b: float, c: float) -> Column:
    """Score of a rate: 1 up to a, down to 0.7 at b, 0.3 at c, then to 0 at the pace of 0.3 in c."""
    return F.when(rate <= a, 1.0).when(rate <= b, 1 - (rate - a) / (b - a) * 0.3).when(rate <= c, 0.7 - (rate - b) / (c - b) * 0.4).otherwise(F.greatest(0.3 - (rate - c) / c * 0.3, F.lit(0.0)))


def execution_scores(features: DataFrame) -> DataFrame:
    """Scores of every episode with two frames or more, and the weighted overall score."""
    rows = jerk_ranks(rates(features)).withColumnRenamed("jerk_rank_score", "jerk_score")
    rows = rows.withColumns({"units_score": falling(F.col("unit_rate"), 1.5, 3, 5), "hesitation_score": falling(F.col("hesitation_rate"), 0.5, 1.5, 3), "submovement_score": F.when(F.col("submovement_rate") > 8, F.greatest(0.3 - (F.col("submovement_rate") - 8) / 4 * 0.3, F.lit(0.0))).otherwise(falling(F.col("submovement_rate"), 3, 5, 8))})
    overall = 0.30 * F.col("units_score") + 0.25 * F.col("hesitation_score") + 0.25 * F.col("submovement_score") + 0.20 * F.col("jerk_score")
    return rows.withColumns({"overall_score": overall, "sparc_score": F.coalesce(F.least(F.greatest((-F.col("sparc") - 1) / 2, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)), "control_confidence": (F.col("hesitation_score") + F.col("submovement_score")) / 2})


def execution_summary(scores: DataFrame) -> DataFrame:
    """metric, n, mean, std, min, max of the execution scores over all episodes."""
    names = ["units_score", "hesitation_score", "submovement_score", "jerk_score", "sparc_score", "overall_score"]
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("score")) for n in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
