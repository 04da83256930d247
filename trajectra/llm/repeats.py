"""Repeated windows of a corpus: the plan shared by both substring operators.

A window is W consecutive units (bytes or words) of one document.  Of every window the
k-gram with the least hash among its W-k+1 k-grams is its anchor, so equal windows hold
equal anchors at equal offsets, and only anchors have to meet in a shuffle:

1. each task hashes its documents and emits its anchors with a hash of their whole
   context (the units that any window around the anchor can reach);
2. anchors meet by hash.  One whose context stood earlier is repeated with all its
   windows; one that stands alone is unique.  Only anchors that occur earlier in another
   context stay open;
3. open anchors fetch their contexts from the documents, meet again, and an exact
   comparison settles each of their windows;
4. an anchor with more than a bound of open contexts, such as a phrase that many documents
   use, isn't compared as one group: each of its windows is a row with a 128-bit
   cryptographic digest of its units, and a plain aggregate, which Spark combines before the
   shuffle and splits as it likes, finds where each digest stood first;
5. the spans found are joined to the documents and applied.

Copies of an anchor inside one task are folded before the shuffle, once their units have
been compared, so a passage that a third of the corpus shares sends a row per task, not a
row per document.  Between tasks, equal contexts are told by a 128-bit cryptographic digest of their units;
the polynomial hash only brings them together inside a task, where they are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajectra.llm.common import broadcast_if_small, chunks, in_batches, written
from trajectra.llm.rolling import TOP, Batch, context_hashes, gram_hashes, mix, winnow

#: Contexts that one exact comparison holds as arrays at a time (groups stay whole).
GROUP_ROWS = 20_000
#: Repeated digests that are broadcast at most; more of them meet the windows in a shuffle.
FEW_DIGESTS = 300_000


def _anchors(batch: Batch, window: int, k: int) -> tuple[np.ndarray, ...]:
    """hash, context hash, place in the batch, units of context left and right of every anchor of a batch."""
    reach = window - k
    hashes = gram_hashes(batch.units, k)
    room = batch.room()[: len(hashes)]
    hashes[room < k] = TOP
    owner = batch.owner()[: len(hashes)]
    at = np.flatnonzero(winnow(hashes, reach + 1) & (room >= k) & (batch.length[owner] >= window))
    left, right = np.minimum(at - batch.start[owner[at]], reach), np.minimum(room[at] - k, reach)
    context = context_hashes(batch.units, at - left, at + k + right)
    context ^= mix((left * 4096 + right).astype(np.uint64))
    return hashes[at], context, at, left, k + right


def _agree(units: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether units[a - left : a + right] and units[b - left : b + right] are equal, row by row."""
    out = np.ones(len(a), dtype=bool)
    if not len(a):
        return out
    around = np.arange(-int(left.max()), int(right.max()))
    step = max(1, most // len(around))
    for i in range(0, len(a), step):
        own = slice(i, i + step)
        inside = (around >= -left[own, None]) & (around < right[own, None])
        x, y = (np.where(inside, units[np.clip(p[own, None] + around, 0, len(units) - 1)], 0) for p in (a, b))
        out[own] = (x == y).all(axis=1)
    return out


def _digests(units: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> dict[int, bytes]:
    """A cryptographic digest of the units around each anchor that stands first among its equals."""
    lead = np.unique(first)
    data, size = units.tobytes(), units.dtype.itemsize
    digest = lambda p, a, b: hashlib.blake2b(data[(p - a) * size : (p + b) * size], digest_size=16, key=b"%d,%d" % (a, b)).digest()
    return {f: digest(p, a, b) for f, p, a, b in zip(lead.tolist(), at[lead].tolist(), left[lead].tolist(), right[lead].tolist())}


def anchors(docs: DataFrame, load: Callable, window: int, k: int, across: bool) -> DataFrame:
    """Anchors of docs(doc_id, text): key, context, doc, pos, done.

    across: only a smaller doc_id counts as earlier, not an earlier place in the same one.
    done: the same context was met earlier in the same task; such rows carry no hashes
    and are only spread by their position.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["doc_id"].to_numpy()
            for a, b in chunks(texts):
                batch = load(texts[a:b])
                key, context, at, left, right = _anchors(batch, window, k)
                local = np.searchsorted(batch.start, at, side="right") - 1
                doc, pos = ids[a:b][local], (at - batch.start[local]).astype(np.int32)
                order = np.lexsort((pos, doc, context, key))
                key, context, at, left, right, doc, pos = (x[order] for x in (key, context, at, left, right, doc, pos))
                fresh = np.ones(len(key), dtype=bool)
                fresh[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
                again = np.flatnonzero(~fresh)
                same = (left[again] == left[first[again]]) & (right[again] == right[first[again]])
                same &= _agree(batch.units, at[again], at[first[again]], left[again], right[again])
                apart = again[~same]  # hashes that collide
                context[apart] = ~context[apart]
                first[apart] = apart
                key = key.view(np.int64)
                shown = _digests(batch.units, at, left, right, first)
                # rows of one doc_id give the same anchor again, which doesn't repeat itself
                done = (doc > doc[first]) | ((pos > pos[first]) & (not across))
                spread = mix(doc.astype(np.uint64) * np.uint64(0x9E3779B1) + pos.astype(np.uint64)).view(np.int64)
                yield pd.DataFrame({"key": np.where(done, spread, key), "context": [None if d else shown[f] for d, f in zip(done.tolist(), first.tolist())], "doc": doc, "pos": pos, "done": done})

    return docs.mapInPandas(run, "key long, context binary, doc long, pos int, done boolean")


def settled(found: DataFrame, across: bool, most: int) -> DataFrame:
    """Anchors that are repeated (key null) or still open: doc, pos, key, hot (of more than `most` contexts)."""
    per_key = Window.partitionBy("key", "done")
    per_context = Window.partitionBy("key", "done", "context").orderBy("doc", "pos")
    ranked = found.repartition("key").withColumns(
        {
            "first_doc": F.first("doc").over(per_context),
            "first_pos": F.first("pos").over(per_context),
            "one_context": F.min("context").over(per_key) == F.max("context").over(per_key),
            "one_doc": F.min("doc").over(per_key) == F.max("doc").over(per_key),
            "hot": F.count("*").over(per_key) > most,
        }
    )
    later = F.col("doc") > F.col("first_doc")
    repeated = F.col("done") | (later if across else later | (F.col("pos") > F.col("first_pos")))
    still_open = ~F.col("one_context")
    if across:
        still_open &= ~F.col("one_doc")
    return ranked.where(repeated | still_open).select("doc", "pos", F.when(~repeated, F.col("key")).alias("key"), "hot")


def contexts(docs: DataFrame, open_: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """The units around every open anchor; cut(texts, list of position arrays) makes the columns."""
    asked = open_.groupBy("doc").agg(F.collect_list(F.struct("pos", "key")).alias("asked"))
    joined = docs.join(asked, docs["doc_id"] == asked["doc"]).select("doc", "text", "asked.pos", "asked.key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in chunks(texts):
                at = [np.asarray(p, dtype=np.int64) for p in frame["pos"][a:b]]
                out = cut(texts[a:b], at)
                counts = [len(p) for p in at]
                yield pd.DataFrame({"key": np.concatenate([np.asarray(x, dtype=np.int64) for x in frame["key"][a:b]]), "doc": np.repeat(frame["doc"].to_numpy()[a:b], counts), "pos": np.concatenate(at), **out})

    return joined.mapInPandas(run, f"key long, doc long, pos int, {schema}")


def compared(rows: DataFrame, compare: Callable) -> DataFrame:
    """Spans that compare() finds repeated, from contexts that meet by key: doc, begin, end.

    compare(frame) gets whole groups in the order of key, doc and pos and returns, for each
    row, the units to the left and to the right of the anchor's start that are repeated
    (right 0: none).
    """
    ordered = rows.repartition("key").sortWithinPartitions("key", "doc", "pos")

    def spans(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = compare(frame)
        hit = right > 0
        pos = frame["pos"].to_numpy()[hit].astype(np.int64)
        return pd.DataFrame({"doc": frame["doc"].to_numpy()[hit], "begin": pos - left[hit], "end": pos + right[hit]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for frame in frames:
            kept.append(frame)
            if sum(map(len, kept)) < GROUP_ROWS:
                continue
            whole = pd.concat(kept, ignore_index=True)
            last = int(np.searchsorted(whole["key"].to_numpy(), whole["key"].iloc[-1]))
            if last:
                yield spans(whole.iloc[:last].reset_index(drop=True))
            kept = [whole.iloc[last:]]
        if kept:
            yield spans(pd.concat(kept, ignore_index=True))

    return ordered.mapInPandas(run, "doc long, begin long, end long")


def hot_spans(docs: DataFrame, open_: DataFrame, slices: Callable, window: int, k: int, across: bool) -> DataFrame:
    """Spans of the open anchors that are in too many contexts for one group: doc, begin, end.

    slices(texts) makes for each text its length in units and a function of a window's first
    unit, which gives the window's units as bytes.
    """
    asked = open_.groupBy("doc").agg(F.collect_list("pos").alias("at"))
    joined = docs.join(asked, docs["doc_id"] == asked["doc"]).select("doc", "text", "at")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in chunks(texts):
                doc, pos, begin, digest = [], [], [], []
                for own, at, (length, units) in zip(frame["doc"].tolist()[a:b], frame["at"].tolist()[a:b], slices(texts[a:b])):
                    for p in at:
                        for start in range(max(0, p - window + k), min(p, length - window) + 1):
                            doc.append(own)
                            pos.append(p)
                            begin.append(start)
                            digest.append(hashlib.blake2b(units(start), digest_size=16).digest())
                yield pd.DataFrame({"doc": np.array(doc, np.int64), "pos": np.array(pos, np.int64), "begin": np.array(begin, np.int64), "digest": digest})

    rows = written(joined.mapInPandas(run, "doc long, pos long, begin long, digest binary"), "windows")
    # only digests that stand more than once can repeat; being few, they go to the rows
    first = rows.groupBy("digest").agg(F.min(F.struct("doc", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = broadcast_if_small(written(first, "digests"), FEW_DIGESTS)
    later = F.col("doc") > F.col("first.doc")
    if not across:
        later |= (F.col("doc") == F.col("first.doc")) & (F.col("begin") > F.col("first.begin"))
    hits = rows.join(first, "digest").where(later).groupBy("doc", "pos")
    # all windows of an anchor overlap, so they cover one span
    return hits.agg(F.min("begin").alias("begin"), (F.max("begin") + window).alias("end")).select("doc", "begin", "end")


def repeated_spans(docs: DataFrame, load: Callable, cut: Callable, slices: Callable, compare: Callable, schema: str, window: int, k: int, across: bool, most: int) -> DataFrame:
    """Per document with repeats: doc, spans (array of begin and end in units, unmerged).

    docs: doc_id (not null) and text (not null).  Spans may reach over the document's ends.
    most: open contexts that an anchor may have to be compared as one group.
    """
    reach = window - k
    docs = in_batches(docs)
    state = written(settled(anchors(docs, load, window, k, across), across, most), "anchors")
    open_ = state.where(F.col("key").isNotNull())
    late = compared(contexts(docs, open_.where("not hot"), cut, schema), compare)
    hot = hot_spans(docs, open_.where("hot"), slices, window, k, across)
    early = state.where(F.col("key").isNull()).select("doc", (F.col("pos") - reach).cast("long").alias("begin"), (F.col("pos") + window).cast("long").alias("end"))
    return early.unionByName(late).unionByName(hot).groupBy("doc").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))


def covered(begins, ends, length: int) -> np.ndarray:
    """Mask of the units inside any span, clipped to the document."""
    mask = np.zeros(length + 1, dtype=np.int64)
    if begins is not None and len(begins):
        np.add.at(mask, np.clip(np.asarray(begins), 0, length), 1)
        np.add.at(mask, np.clip(np.asarray(ends), 0, length), -1)
    return np.cumsum(mask[:-1]) > 0
