"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic classifier on surface statistics of the text (fitted in numpy on a bounded sample
of labelled rows, SAMPLE) gives each document its own evidence.  Evidence is summed per path
and per host by grouped aggregation.  Beta priors are fitted by the method of moments: hosts
shrink toward the corpus mean with the strength that the spread between hosts calls for, paths
toward their host likewise, so sparse sites stay near their prior.  A document's score is its
own evidence moved by how far its path's posterior (without the document itself) departs from
the corpus mean.

Operator: `quality`.  Only sums per path, host and corpus are shuffled; the corpus's few sums
reach the driver.

Cases: a null or empty text has the statistics of an empty text; null hosts or paths are sites
of their own; rows with null or repeated doc_ids are scored like others; without labelled rows
of both classes all evidence is 0.5; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm.common import chunks, documents, labelled_sample, written
from trajectra.llm.rolling import gram_hashes, words_of
from trajectra.llm.toxicity import held_out

#: Labelled rows of class 0 and 1 that the classifier is fitted on at most.
SAMPLE = (2000, 2000)
LIMIT = 0.5
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r\x0b\x0c", ".,;:'\"()-", "!?", "#$%&*@^~+=<>_/\\", "|{}[]`")
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _i, _signs in enumerate(_KINDS):
    _CLASS[[ord(c) for c in _signs]] = _i
FEATURES = len(_KINDS) + 8


def statistics(texts: list[str]) -> np.ndarray:
    """FEATURES numbers per text: shares of kinds of signs, word lengths and repetition."""
    raw = [t.encode() for t in texts]
    batch, first, last = words_of(raw)
    out = np.zeros((len(texts), FEATURES))
    size = np.array([len(r) for r in raw], dtype=np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    kinds = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    starts = (np.cumsum(size) - size)[some]
    for k in range(len(_KINDS)):
        out[some, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64) / size[some]
    n, owner, at = batch.length, batch.owner(), len(_KINDS)
    words = np.maximum(1, n)
    units = batch.units
    order = np.lexsort((units, owner))
    fresh = np.ones(len(units), bool)
    fresh[1:] = (units[order][1:] != units[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    out[:, at] = np.bincount(owner[order][fresh], minlength=len(texts)) / words
    same = np.zeros(len(units), bool)
    same[1:] = (units[1:] == units[:-1]) & (owner[1:] == owner[:-1])
    out[:, at + 1] = np.bincount(owner[same], minlength=len(texts)) / words
    out[:, at + 2] = np.bincount(owner, weights=last - first, minlength=len(texts)) / words / 10
    out[:, at + 3] = np.bincount(owner[last - first <= 1], minlength=len(texts)) / words
    grams = gram_hashes(units, 3)
    whole = batch.room()[: len(grams)] >= 3
    gram, own = grams[whole], owner[: len(grams)][whole]
    order = np.lexsort((gram, own))
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[order][1:] != gram[order][:-1]) | (own[order][1:] != own[order][:-1])
    out[:, at + 4] = np.bincount(own[order][fresh], minlength=len(texts)) / np.maximum(1, np.bincount(own, minlength=len(texts)))
    out[:, at + 5] = np.log1p(n) / 10
    out[:, at + 6] = n == 0
    out[:, at + 7] = np.log1p(size) / 10
    return out


class Evidence:
    """A logistic model over standardised statistics and their squares."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weight: np.ndarray):
        self.mean, self.spread, self.weight = mean, spread, weight

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(statistics(texts)) @ self.weight, -8, 8)))

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([z, z**2, np.ones((len(z), 1))], axis=1)


def trained(sample: list[tuple[str, int]], rounds: int = 40, ridge: float = 1.0) -> Evidence:
    """Fits Evidence by iterated reweighted least squares."""
    y = np.array([v for _, v in sample], dtype=float)
    if len(set(y)) < 2:
        return Evidence(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES + 1))
    x = np.concatenate([statistics([t for t, _ in sample[a : a + 200]]) for a in range(0, len(sample), 200)])
    model = Evidence(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(2 * FEATURES + 1))
    d = model._design(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ model.weight, -30, 30)))
        w = p * (1 - p) + 1e-6
        step = np.linalg.solve((d * w[:, None]).T @ d + ridge * np.eye(d.shape[1]), d.T @ (y - p) - ridge * model.weight)
        model.weight = model.weight + step
        if np.abs(step).max() < 1e-6:
            break
    return model


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def _strength(mean: float, between: float, within: float, least: float = 2.0, most: float = 1e6) -> float:
    """Prior counts of a Beta whose means have the variance that sampling does not explain."""
    variance = between - within
    return most if variance <= 0 else min(most, max(least, mean * (1 - mean) / variance - 1))


def quality(docs: DataFrame, host: Column, path: Column, model: Evidence, limit: float = LIMIT) -> DataFrame:
    """doc_id, evidence, path_posterior, score, keep per row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            p = np.concatenate([shared.value.probabilities(texts[a:b]) for a, b in chunks(texts)]) if texts else np.zeros(0)
            yield pd.DataFrame({"id": frame["id"], "host": frame["host"], "path": frame["path"], "p": p})

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    found = written(rows.mapInPandas(run, "id string, host string, path string, p double"), "evidence")
    paths = found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.count("*").alias("k"))
    # sums over hosts for the two priors: spread of hosts about the corpus, of paths about their host
    total = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("hosts"), F.sum("between").alias("paths"), F.count("*").alias("h"), F.sum("k").alias("k")
    ).first()
    n = total["n"] or 0
    mean = min(1 - 1e-4, max(1e-4, total["s"] / n)) if n else 0.5
    noise = mean * (1 - mean)
    between = max(0.0, (total["hosts"] or 0) / n - mean**2) if n else 0.0
    inside = max(0.0, ((total["paths"] or 0) - (total["hosts"] or 0)) / n) if n else 0.0
    host_prior = _strength(mean, between, noise * (total["h"] or 0) / max(1, n))
    path_prior = _strength(mean, inside, noise * ((total["k"] or 0) - (total["h"] or 0)) / max(1, n))
    # a document's own evidence is left out of its site's posterior
    by_path = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s")
    by_host = hosts.select(F.col("host").alias("hh"), "hn", "hs")
    joined = by_path.join(by_host, F.col("h").eqNullSafe(F.col("hh"))).drop("hh")
    sites = F.broadcast(joined) if joined.limit(200_001).count() <= 200_000 else joined
    all_ = found.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    of_host = (F.lit(host_prior * mean) + F.col("hs") - F.col("p")) / (F.lit(host_prior) + F.col("hn") - 1)
    of_path = (F.lit(path_prior) * F.col("of_host") + F.col("s") - F.col("p")) / (F.lit(path_prior) + F.col("n") - 1)
    scored = all_.withColumn("of_host", of_host).withColumn("path_posterior", of_path)
    logit = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    scored = scored.withColumn("score", F.round(1 / (1 + F.exp(-logit)), 6))
    return scored.select(F.col("id").cast("long").alias("doc_id"), F.round("p", 6).alias("evidence"), F.round("path_posterior", 6).alias("path_posterior"), "score", (F.col("score") >= limit).alias("keep"))


def op4_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = trained(labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "quality", SAMPLE))
    return quality(docs, F.col("source"), F.col("lang"), model)
