"""Frames as a stream: late frames are dropped by watermark, and episodes summed per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, folder: str, schema: StructType | str = EVENTS, files: int = 1) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*events*.parquet").parquet(folder)


def episode_sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Per user and session (broken by a gap): frames, first and last value, mean value."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("frames"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    return sums.select(F.col("user_id").alias("episode_index"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "low", "high", "mean")
