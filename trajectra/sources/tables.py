"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast.
BROADCAST_ROWS = 1_000_000
#: The attribute of a DataFrame that names the folder `written` has put it in.
_FOLDER = "_trajectra_folder"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can read.

    It is the one in spark.checkpoint.dir; only a local session (a test) without that setting
    gets a folder of its own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trajectra-"))
        found = context.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    setattr(made, _FOLDER, path)
    return made


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` returned, once all that was made of them is written."""
    for table in tables:
        if path := getattr(table, _FOLDER, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
