"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.sources.tables import broadcast_if_small, dropped, shared_dir, written  # noqa: F401

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents a task holds as arrays at a time, in characters of text.
CHUNK_CHARS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of a batch that goes to a Python worker at most; a batch holds whole texts.
BATCH_ROWS = 2_000


def in_batches(docs: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """docs, after bounding the session's Arrow batches, which bounds the memory of its Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def lowered(text: Column) -> Column:
    """text with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chunks(texts, most: int = CHUNK_CHARS):
    """(from, to) of successive slices of texts, each of about `most` characters at most."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], seed: int = 7) -> list:
    """(text, label) of at most per_class[k] rows of class k, by seeded order of doc_id.

    The sample is drawn from labels alone; only its documents' texts come to the driver.
    Repeated rows of a doc_id with one label count once.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    drawn = [known.where(F.col("label") == k).distinct().orderBy(order, "doc_id").limit(per_class[k]) for k in (0, 1)]
    sample = drawn[0].unionByName(drawn[1]).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    sample = sample.where(F.col("label") == F.col("most")).select("doc_id", "label")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def release() -> None:
    """Give the memory that training has freed back to the system, where the C library can; the driver lives on."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def ids(values) -> object:
    """doc_ids that came as strings, as a nullable column of whole numbers (null-safe and exact)."""
    import pandas as pd

    return pd.array([None if v is None else int(v) for v in values], dtype="Int64")
