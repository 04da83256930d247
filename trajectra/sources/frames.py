"""Frame tables: one row per frame of a recorded episode.

frames: episode_index BIGINT, frame_index INT, timestamp DOUBLE (seconds), state
ARRAY<DOUBLE>, action ARRAY<DOUBLE>.  Adapters make such a table from other tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectra.operators.ordering import running

FPS = 30.0


def read_frames(spark: SparkSession, path: str, max_episodes: int | None = None) -> DataFrame:
    """Frames from Parquet; a limit on episodes reaches the scan as a filter."""
    frames = spark.read.parquet(path)
    return frames if max_episodes is None else frames.where(F.col("episode_index") < max_episodes)


def write_frames(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").parquet(path)


def _ordered(table: DataFrame, episode: str, order: list[str], state: Column, clock: Column | None = None) -> DataFrame:
    w = Window.partitionBy("episode_index").orderBy(*order)
    rows = table.withColumn("episode_index", F.col(episode).cast("long")).withColumn("frame_index", (F.row_number().over(w) - 1).cast("int"))
    rows = rows.withColumn("timestamp", F.col("frame_index") / F.lit(FPS) if clock is None else clock)
    following = F.lead("state").over(Window.partitionBy("episode_index").orderBy("frame_index"))
    return rows.withColumn("state", state).select("episode_index", "frame_index", "timestamp", "state", F.coalesce(following, "state").alias("action"))


def events_frames(spark: SparkSession, sf_dir: str, real_clock: bool = False) -> DataFrame:
    """An episode per user: (value, props.k); the action is the next state."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = F.array("value", F.get_json_object("props", "$.k").cast("double"))
    first = F.min("ts").over(Window.partitionBy("user_id"))
    clock = F.timestamp_diff("MICROSECOND", first, F.col("ts")) / 1e6 if real_clock else None
    return _ordered(events, "user_id", ["ts", "event_id"], state, clock)


def lineitem_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode per supplier: (quantity, extendedprice, discount, tax)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", *names, "l_returnflag", "l_linestatus"]
    return _ordered(items, "l_suppkey", order, F.array(*[F.col(n) + 0.0 for n in names]))


def embedding_frames(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """An episode per label: the first dims numbers of each vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _ordered(vectors, "label", ["vec_id"], F.slice("embedding", 1, dims).cast("array<double>"))


def features(frames: DataFrame) -> DataFrame:
    """name and type of every column."""
    return frames.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in frames.schema], "name string, type string")


def metadata(frames: DataFrame) -> DataFrame:
    """One row: episodes, frames, state and action size, mean episode length."""
    return frames.agg(
        F.countDistinct("episode_index").alias("total_episodes"), F.count("*").alias("total_frames"), F.max(F.size("state")).alias("state_dim"), F.max(F.size("action")).alias("action_dim")
    ).withColumn("avg_episode_length", F.col("total_frames") / F.greatest("total_episodes", F.lit(1)))


def episode_ranges(frames: DataFrame) -> DataFrame:
    """start_frame, end_frame (exclusive) and length of every episode in the order of the whole table."""
    counts = frames.groupBy("episode_index").agg(F.count("*").alias("length"))
    return running(counts, "episode_index", F.col("length"), "end_frame").withColumn("start_frame", F.col("end_frame") - F.col("length")).select("episode_index", "start_frame", "end_frame", "length")


def episode(frames: DataFrame, k: int) -> DataFrame:
    """The frames of episode k in order; an episode that isn't there is an error."""
    found = frames.where(F.col("episode_index") == k)
    if k < 0 or found.isEmpty():
        raise ValueError(f"episode {k} is not in the table")
    return found.orderBy("frame_index")


def with_ids(frames: DataFrame) -> DataFrame:
    """frames with id, the place of each in the order of episode and frame."""
    place = F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1
    return frames.join(episode_ranges(frames).select("episode_index", "start_frame"), "episode_index").withColumn("id", F.col("start_frame") + place).drop("start_frame")


def frame_at(frames: DataFrame, i: int) -> DataFrame:
    """The frame with id i; one that isn't there is an error."""
    span = episode_ranges(frames).where((F.col("start_frame") <= i) & (F.col("end_frame") > i)).first()
    if span is None:
        raise ValueError(f"frame {i} is not in the table")
    own = Window.partitionBy("episode_index").orderBy("frame_index")
    rows = frames.where(F.col("episode_index") == span["episode_index"]).withColumn("id", F.row_number().over(own) - 1 + F.lit(span["start_frame"]))
    return rows.where(F.col("id") == i)


def loaded(spark: SparkSession, path: str, strategy: str = "auto", max_episodes: int | None = None) -> DataFrame:
    """Frames of the sampled episodes of a Parquet folder."""
    frames = read_frames(spark, path)
    return restricted(frames, sampled_episodes(frames, strategy, max_episodes))


def sampled_episodes(frames: DataFrame, strategy: str = "auto", max_episodes: int | None = None, seed: int = 42) -> DataFrame:
    """Episodes to analyse: all, random (seeded, without replacement), sequential, or auto.

    auto takes all below 500 episodes, else random; any other name is sequential.
    """
    episodes = frames.select("episode_index").distinct()
    if strategy == "auto":
        strategy = "all" if episodes.count() < 500 else "random"
    if strategy == "all":
        return episodes
    if strategy == "random":
        return episodes.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("episode_index").cast("string"))), "episode_index").limit(max_episodes or 100)
    return episodes if max_episodes is None else episodes.where(F.col("episode_index") < max_episodes)


def restricted(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Frames of the chosen episodes."""
    return frames.join(episodes, "episode_index", "left_semi")


def video_candidates(episode_index: int, camera: str) -> list[str]:
    """Relative paths under which a camera's video of an episode may lie, by preference."""
    return [f"videos/{camera}/episode_{episode_index:06d}.mp4", f"videos/observation.images.{camera}/episode_{episode_index:06d}.mp4"]


def video_path(episode_index: int, camera: str, exists: Callable[[str], bool]) -> str | None:
    """The first of the candidates that exists() finds."""
    return next((p for p in video_candidates(episode_index, camera) if exists(p)), None)


def camera_names(frames: DataFrame) -> list[str]:
    prefix = "observation.images."
    return [c.removeprefix(prefix) for c in frames.columns if c.startswith(prefix)]


def subsampled(frames: DataFrame, most: int) -> DataFrame:
    """At most `most` frames of each episode, evenly: every (n // most)-th from the first."""
    w = Window.partitionBy("episode_index")
    step = F.greatest(F.floor(F.count("*").over(w) / most), F.lit(1))
    return frames.withColumn("step_", step).where((F.col("frame_index") % F.col("step_") == 0) & (F.col("frame_index") / F.col("step_") < most)).drop("step_")
