"""Episodes in parts, so that no task holds a long one.

An episode is cut into chunks of SIZE frames.  Each chunk also gets the frames within HALO of its
borders, so that what depends on frames near by has the value it has in the whole episode.
frame_index numbers the frames of an episode from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, HALO = 4096, 96


def chunked(frames: DataFrame, columns: dict[str, Column], size: int = SIZE, halo: int = HALO) -> DataFrame:
    """A row per chunk: episode_index, chunk, own (which of its frames it doesn't borrow), frame_index and columns as arrays in order."""
    if size < halo:
        raise ValueError("a chunk is as long as its halo at least")
    i = F.col("frame_index")
    home = F.floor(i / size)
    at = F.array_compact(F.array(home, F.when((i - home * size < halo) & (home > 0), home - 1), F.when((home + 1) * size - i <= halo, home + 1)))
    rows = frames.select("episode_index", F.explode(at).alias("chunk"), F.struct("frame_index", home.alias("home_"), *[c.alias(n) for n, c in columns.items()]).alias("r"))
    made = rows.groupBy("episode_index", "chunk").agg(F.array_sort(F.collect_list("r")).alias("r"))
    own = F.transform("r", lambda r: r["home_"] == F.col("chunk"))
    # a chunk of borrowed frames alone lies beyond the episode's end
    return made.select("episode_index", "chunk", own.alias("own"), *[F.col(f"r.{n}").alias(n) for n in ("frame_index", *columns)]).where(F.exists("own", lambda o: o))


def vectors(column: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    """Row k of a column of arrays of vectors, as a matrix."""
    rows = column[k].values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


def numbers(column: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    """Row k of a column of arrays of numbers."""
    return column[k].values.to_numpy(zero_copy_only=False)


def lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a column of vectors."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
