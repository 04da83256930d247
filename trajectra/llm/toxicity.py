"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character n-grams (3 to 5, with word borders) and words of its
words.  Every entry has an embedding (hashed into BUCKETS rows); the mean embedding of the
bag goes through a linear softmax over the two classes.  Embeddings and softmax are trained
jointly in numpy, so a misspelling that was never seen scores through the n-grams it shares.
A text is scored by the bag of its WORST most toxic words, wherever they stand, so that a long
text does not drown a few insults, and training repeats this: each text teaches with the
words that the model finds most toxic.

Operators: `trained` (fits on a bounded sample of labelled rows: PER_CLASS rows of the classes)
and `scored`.  Only the text enters a score.

Cases: a null or empty text scores as a text without words (the classes' bias); texts of any
length are scored whole; rows with null or repeated doc_ids are scored like others; without
labelled rows of both classes every score is 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm.common import chunks, documents, ids, in_batches, labelled_sample, release
from trajectra.llm.rolling import SPACE, gram_hashes, prefix_hashes, span_hashes, word_spans

#: Rows of the embedding; a bucket fits in 16 bits.
BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
#: Words of a text that its score is taken from.
WORST = 3
#: Labelled rows of class 0 and 1 that the model is fitted on at most.
PER_CLASS = (3000, 1500)
#: Passes over the sample, more of them for a small sample: at least so many steps of BATCH rows in all.
EPOCHS, STEPS, BATCH = 8, 600, 64
RATE = 0.02
SEED = 5
LIMIT = 0.7
#: Signs that end a word for the bag; others (like * @ $) stay, as misspellings use them.
_BREAKS = bytes(0x20 if chr(i) in ".,;:!?()[]{}\"\t\n\r\x0b\x0c" else i for i in range(256))


def entries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every bag entry of texts laid end to end, and the words of each text."""
    raw = [b" " + t.lower().encode().translate(_BREAKS) + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    borders = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    first, last = word_spans(data, borders)
    words = np.diff(np.searchsorted(first, borders))
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), words
    word_at = np.cumsum(np.bincount(first, minlength=len(data))) - 1  # the word at or before a byte
    gap = SPACE[data]
    before = np.concatenate([[0], np.cumsum(gap)])
    buckets = [(span_hashes(prefix_hashes(data), first, last) % np.uint64(BUCKETS)).astype(np.int32)]
    owners = [np.arange(len(first))]
    for k in GRAMS:
        hashes = gram_hashes(data, k)
        inner = before[k - 1 : k - 1 + len(hashes)] - before[1 : 1 + len(hashes)]  # gaps inside the n-gram
        at = np.flatnonzero(inner == 0)
        buckets.append((hashes[at] % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(word_at[at + 1])
    return np.concatenate(buckets), np.concatenate(owners), words


def worst_words(total: np.ndarray, size: np.ndarray, text: np.ndarray, most: int = WORST) -> np.ndarray:
    """The `most` words of each text with the highest mean margin (of equal ones the first), from sums, sizes and texts of all words."""
    order = np.lexsort((-total / np.maximum(1, size), text))
    first = np.searchsorted(text[order], text[order])
    return order[np.arange(len(order)) - first < most]


class Model:
    """Embeddings (bucket x dimension) and a linear softmax over the classes."""

    def __init__(self, embedding: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.embedding, self.softmax, self.bias = embedding, softmax, bias

    def margin(self) -> np.ndarray:
        """What each entry adds: the softmax of a mean is linear in its entries."""
        return self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])

    def scores(self, texts: list[str], most: int = WORST) -> np.ndarray:
        """Probability of class 1, of the bag of each text's most toxic words."""
        bucket, owner, words = entries(texts)
        n = int(words.sum())
        total, size = np.bincount(owner, weights=self.margin()[bucket], minlength=n), np.bincount(owner, minlength=n)
        text = np.repeat(np.arange(len(texts)), words)
        at = worst_words(total, size, text, most)
        whole, entries_ = (np.bincount(text[at], weights=v[at], minlength=len(texts)) for v in (total, size))
        return 1 / (1 + np.exp(-np.clip(whole / np.maximum(1, entries_) + self.bias[1] - self.bias[0], -500, 500)))


def trained(sample: list[tuple[str, int]], epochs: int | None = None, seed: int = SEED) -> Model:
    """A model fitted to (text, label) rows by Adam on the cross entropy."""
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax, bias = random.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32), np.array([2.0, -2.0], np.float32)
    model = Model(embedding, softmax, bias)
    if len({y for _, y in sample}) < 2:
        return Model(embedding * 0, softmax, np.array([500.0, -500.0], np.float32))
    label = np.array([y for _, y in sample])
    if epochs is None:  # a clean text gives two rows in a pass
        epochs = max(EPOCHS, -(-STEPS * BATCH // int(len(label) + (label == 0).sum())))
    parts = []  # per text: entries in the order of their words, and the words' borders in them
    texts = [t for t, _ in sample]
    for a, b in chunks(texts, 100_000):
        bucket, owner, words = entries(texts[a:b])
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(int(words.sum()) + 1)).astype(np.int32)
        bucket = bucket[order].astype(np.uint16)
        ends = np.cumsum(words)
        parts += [(bucket[cut[i] : cut[j]], cut[i : j + 1] - cut[i]) for i, j in zip((ends - words).tolist(), ends.tolist())]
    values = [embedding, softmax, bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for epoch in range(epochs):
        margin = model.margin()
        rows: list[np.ndarray] = []
        classes: list[int] = []
        for (bucket, cut), y in zip(parts, label):
            n = len(cut) - 1
            if not n:
                continue
            bag = lambda words: np.concatenate([bucket[cut[w] : cut[w + 1]] for w in words])  # noqa: B023,E731
            if epoch == 0 and y:
                rows.append(bucket)  # nothing is learnt yet: the whole toxic text, which holds its insults for sure
            elif epoch == 0:
                rows.append(bag(random.integers(n, size=WORST)))
            else:
                upto = np.concatenate([[0.0], np.cumsum(margin[bucket], dtype=float)])
                rows.append(bag(worst_words(upto[cut[1:]] - upto[cut[:-1]], np.diff(cut), np.zeros(n, int))))
            classes.append(int(y))
            if not y:  # and any others of a clean text's words
                rows.append(bag(random.integers(n, size=WORST)))
                classes.append(0)
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = [i for i in order[at : at + BATCH] if len(rows[i])]
            if not batch:
                continue
            sizes = np.array([len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            y = np.eye(2, dtype=np.float32)[[classes[i] for i in batch]]
            mean = np.add.reduceat(model.embedding[flat], starts, axis=0) / sizes[:, None]
            logit = mean @ model.softmax + model.bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            wrong = (p - y) / len(batch)
            spread = np.repeat((wrong @ model.softmax.T) / sizes[:, None], sizes, axis=0)
            grad = [np.stack([np.bincount(flat, weights=spread[:, d], minlength=BUCKETS) for d in range(DIMENSIONS)], axis=1).astype(np.float32), mean.T @ wrong, wrong.sum(axis=0)]
            step += 1
            for v, g, m, s in zip(values, grad, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def scored(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """doc_id, score, predicted per row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.embedding, model.softmax, model.bias))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for frame in frames:
            texts = frame["text"].tolist()
            score = np.concatenate([own.scores(texts[a:b]) for a, b in chunks(texts)]) if texts else np.zeros(0)
            yield pd.DataFrame({"doc_id": ids(frame["id"]), "score": score, "predicted": (score >= limit).astype(np.int32)})

    plain = in_batches(docs).select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInPandas(run, "doc_id long, score double, predicted int")


def held_out(doc_id) -> object:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Model:
    """A model fitted on labelled rows outside the held-out third."""
    model = trained(labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "toxic", per_class))
    release()
    return model


def op8_toxicity_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
