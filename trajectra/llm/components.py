"""Connected components of a large graph, as Spark joins that converge in a few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges(a, b); label is the least node reachable.

    Alternating large-star and small-star rounds keep every node's links to smaller nodes
    only, so the work stays in proportion to the links, whatever the component's size.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    size = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        following = written(small, "edges")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        # stars: every node has one link, and no node that others link to links on
        if now == size or now[0] == 0:
            break
        dropped(current)
        current, size = following, now
    dropped(current)
    labels = following.groupBy("a").agg(F.min("b").alias("label"))
    roots = following.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return labels.select(F.col("a").alias("node"), "label").unionByName(roots)
