"""Episode folders: data/**/episode_NNNNNN.parquet, one file an episode, and meta/info.json.

A folder is read by Spark's own Parquet reader, so it can lie in any store that Spark reaches.
Which episodes are wanted is told by the names of the files: the filter reaches the listing
of files, and the files of other episodes are never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAMERA = "observation.images."


def episode_number() -> Column:
    """The episode of a row by its file's name."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"episode_(\d+)\.parquet$", 1).cast("long")


def folder_frames(spark: SparkSession, root: str, episodes: list[int] | None = None, max_episodes: int | None = None, state: str = "observation.state") -> DataFrame:
    """Frames of a folder's episodes: all, those named, or those below max_episodes.

    episode_index comes from the file's name; a column that the files don't have is null.
    """
    if episodes is not None and max_episodes is not None:
        raise ValueError("name the episodes or bound their number, not both")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "episode_*.parquet").parquet(f"{root}/data")
    if episodes is not None:
        rows = rows.where(episode_number().isin([int(e) for e in episodes]))
    if max_episodes is not None:
        rows = rows.where(episode_number() < max_episodes)
    vector = T.ArrayType(T.DoubleType())
    own = lambda name, kind: (F.col(f"`{name}`") if name in rows.columns else F.lit(None)).cast(kind)
    images = [F.col(f"`{c}`") for c in rows.columns if c.startswith(CAMERA)]
    return rows.select(episode_number().alias("episode_index"), own("frame_index", "int").alias("frame_index"), own("timestamp", "double").alias("timestamp"), own(state, vector).alias("state"), own("action", vector).alias("action"), *images)


def folder_metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row of meta/info.json: total_episodes, total_frames, fps, robot_type ('unknown' if not told), features and cameras (names)."""
    rows = spark.read.option("multiLine", "true").json(f"{root}/meta/info.json")
    told = {f.name: f.dataType for f in rows.schema}
    features = told["features"].names if isinstance(told.get("features"), T.StructType) else []
    own = lambda name, kind, otherwise=None: F.coalesce((F.col(name) if name in told else F.lit(None)).cast(kind), F.lit(otherwise).cast(kind)).alias(name)
    names = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return rows.select(own("total_episodes", "long"), own("total_frames", "long"), own("fps", "double"), own("robot_type", "string", "unknown"), names(features).alias("features"), names([f.removeprefix(CAMERA) for f in features if f.startswith(CAMERA)]).alias("cameras"))


def folder(spark: SparkSession, root: str, max_episodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(metadata, frames) of a folder."""
    return folder_metadata(spark, root), folder_frames(spark, root, max_episodes=max_episodes)
