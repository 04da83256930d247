"""Substring dedup on words: seeds on winnowed anchors, extended both ways.

Operator: `drop_repeated_words`.  A document loses every word that lies in a run of
`window` consecutive words which also starts in a document with a smaller doc_id.

Seeds are winnowed word 5-grams; documents meet on them.  A seed's partners are then
extended a word at a time to the left and to the right: each step splits the partners into
those that still agree.  A run is repeated if the partners that agree on its left part and
on its right part hold a smaller doc_id; overlapping runs merge into maximal repeats.

Cases: a null text has no words and keeps nothing; texts shorter than the window stay
whole; rows without doc_id take no part and stay whole; rows that repeat a doc_id are the
same document given again (they don't remove each other); an empty table gives an empty
result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm.common import documents
from trajectra.llm.repeats import covered, repeated_spans
from trajectra.llm.rolling import words_of

WINDOW = 13
SEED = 5
#: Contexts of a seed that one task extends at most; a seed with more has each of its 9 windows
#: told by a digest.
HOT_ROWS = 5_000
RESULT = "doc_id long, n_words long, n_removed long, n_repeats long, kept string, kept_sha256 string"


def _load(texts: list[str]):
    return words_of([t.encode() for t in texts])[0]


def _cutter(window: int, k: int):
    """For each anchor the word hashes that its windows reach, left end first, and how many lie left."""
    reach = window - k

    def cut(texts: list[str], at: list[np.ndarray]) -> dict:
        batch = _load(texts)
        words, lefts = [], []
        for start, length, positions in zip(batch.start, batch.length, at):
            own = batch.units[start : start + length].view(np.int64)
            for p in positions:
                a = max(0, p - reach)
                words.append(own[a : p + window])
                lefts.append(p - a)
        return {"words": words, "left": np.array(lefts, dtype=np.int32)}

    return cut


def _slices(texts: list[str], window: int):
    for text in texts:
        data = text.encode()
        _, first, last = words_of([data])
        own = [data[a:b] for a, b in zip(first.tolist(), last.tolist())]
        yield len(own), lambda start, own=own: b" ".join(own[start : start + window])


def _classes(previous: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Number the pairs (previous class, next unit); -1 where the class or the unit is missing."""
    out = np.full(len(previous), -1, dtype=np.int64)
    ok = np.flatnonzero((previous >= 0) & (unit >= 0))
    if len(ok):
        out[ok] = np.unique(previous[ok] * (int(unit[ok].max()) + 1) + unit[ok], return_inverse=True)[1]
    return out


def _comparer(window: int, k: int):
    reach = window - k

    def compare(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = len(frame)
        left = frame["left"].to_numpy()
        lengths = frame["words"].map(len).to_numpy()
        flat = np.unique(np.concatenate(frame["words"].tolist()), return_inverse=True)[1] if n else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)

        def unit(step: int) -> np.ndarray:
            """The word `step` places from the anchor's start, numbered; -1 outside the document."""
            at = left + step
            ok = (at >= 0) & (at < lengths)
            return np.where(ok, flat[np.where(ok, first + at, 0)], -1)

        key = np.unique(frame["key"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        for step in range(k):  # equal hashes, equal words
            key = _classes(key, unit(step))
        lefts, rights = [key], [key]
        for step in range(1, reach + 1):
            lefts.append(_classes(lefts[-1], unit(-step)))
            rights.append(_classes(rights[-1], unit(k + step - 1)))
        doc = frame["doc"].to_numpy()
        most, least = np.full(n, -1), np.full(n, window)
        for offset in range(reach + 1):
            both = _classes(lefts[offset], rights[reach - offset])
            ok = np.flatnonzero(both >= 0)
            if not len(ok):
                continue
            # rows are in the order of doc within a key, so a class's first row has its least doc
            _, earliest, own = np.unique(both[ok], return_index=True, return_inverse=True)
            hit = ok[doc[ok] > doc[ok][earliest][own]]
            most[hit] = np.maximum(most[hit], offset)
            least[hit] = np.minimum(least[hit], offset)
        return np.maximum(most, 0), np.where(most >= 0, window - least, 0)

    return compare


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """RESULT per row of docs(doc_id, text); see the module's docstring."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = plain.where(F.col("doc_id").isNotNull())
    spans = repeated_spans(known, _load, _cutter(window, seed), partial(_slices, window=window), _comparer(window, seed), "words array<long>, left int", window, seed, across=True, most=HOT_ROWS)
    rows = known.join(spans, known["doc_id"] == spans["doc"], "left").select("doc_id", "text", "begins", "ends")
    nulls = plain.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<long>").alias("begins"), F.lit(None).cast("array<long>").alias("ends"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, begins, ends in zip(frame["text"], frame["begins"], frame["ends"]):
                data = text.encode()
                batch, first, last = words_of([data])
                gone = covered(begins, ends, len(first))
                kept = b" ".join(data[a:b] for a, b in zip(first[~gone], last[~gone]))
                repeats = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
                out.append((len(first), int(gone.sum()), repeats, kept.decode(), hashlib.sha256(kept).hexdigest()))
            made = pd.DataFrame(out, columns=["n_words", "n_removed", "n_repeats", "kept", "kept_sha256"])
            made.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield made

    return rows.unionByName(nulls).mapInPandas(run, RESULT)


def op10_substring_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(documents(spark, sf_dir)).drop("kept")


#: DuckDB's rows for op10: windows as lists of words, the least doc_id of each.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM h GROUP BY s),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM h JOIN f USING (s) WHERE h.doc_id > f.first),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id)),
n AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
  array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(gone, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL), ' ') AS kept FROM k),
q AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS z FROM c),
s AS (SELECT doc_id, count(DISTINCT i - z) AS n_repeats FROM q GROUP BY doc_id)
SELECT n.doc_id, n_words, n_removed, coalesce(n_repeats, 0) AS n_repeats, sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN s USING (doc_id)
"""
