"""The corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm import decontaminate, mixing, pii, similarity_join, toxicity
from trajectra.llm.common import broadcast_if_small, written

#: Near duplicates of the pipeline: word shingles of five, similarity 0.8.
SHINGLE, PERCENT = 5, 80


def _by_text(docs: DataFrame) -> DataFrame:
    """doc_id (a hash of the text), text: for what depends on the text alone, whatever the row's doc_id."""
    return docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose text is in gone(doc_id), a hash of the text; rows that lack or share a doc_id are told apart."""
    rows = docs.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(broadcast_if_small(gone.distinct().withColumnRenamed("doc_id", "_text_key")), "_text_key", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    A text decides for all its rows; null and empty texts have no words to reject and score as the
    classes' bias; an empty table stays empty.
    """
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, written(toxicity.scored(_by_text(docs), model).where("predicted = 1").select("doc_id"), "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least doc_id (nulls last) and text hash, of each group of near duplicates.

    Rows without words are in no group and stay.
    """
    found = written(similarity_join.near_duplicates(docs, SHINGLE, PERCENT).where("label is not null"), "groups")
    least = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"))
    judged = found.join(broadcast_if_small(least), "label").withColumn("first", F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))
    rows = docs.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))

    def joined(to: DataFrame, by: DataFrame, how: str) -> DataFrame:
        own = broadcast_if_small(by.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
        return to.join(own, to["doc_id"].eqNullSafe(own["_id"]) & (to["_text_key"] == own["_key"]), how)

    kept = joined(rows, judged.where("not first"), "left_anti")
    # a row that is given again, text and all, is the same document
    again = judged.where("first").groupBy("doc_id", "text_key").count().where("count > 1")
    once = kept if again.isEmpty() else joined(kept, again, "left_anti").unionByName(joined(kept, again, "left_semi").dropDuplicates(["doc_id", "_text_key"]))
    return once.drop("_text_key")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A text decides for all its rows; null and empty texts hold no passage and stay; an empty table stays empty.
    """
    found = written(decontaminate.leaks(_by_text(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"), "leaks")
    return _without(docs, found)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, with personal data replaced by its kind and n_chars of the new text; null texts stay null."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of times it repeats them; rows without words or with no repeats left go."""
    mixed, _ = mixing.mix(docs, F.array("source"))
    return mixed.where("repeats > 0").select("doc_id", "pattern", "size", "repeats", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: The trained stages can't be told in SQL; tests/llm/test_pipeline.py tells what each stage keeps row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
