"""Substring dedup on bytes by a hash-compared suffix sort.

Operator: `drop_repeated_bytes`.  A document loses every UTF-8 byte that lies in a
`window`-byte string which also starts earlier: in a document with a smaller doc_id, or
further left in the same one.

Suffixes of the corpus meet by their anchor (see repeats).  Within an anchor's group they
are sorted by a merge sort that compares two suffixes through prefix polynomial hashes: a
binary search for the longest common extension, then one byte, so a comparison takes a
logarithm of the window.  Neighbours in the order give the common extension of every pair,
to the right and, over the reversed left contexts, to the left; a window is repeated if an
earlier suffix shares both of its parts.  Extensions are compared byte by byte before they
count, so a collision of hashes cannot make a match.

Cases: a null text is empty; texts shorter than the window stay whole; overlapping
occurrences count; rows without doc_id take no part and stay whole; rows that repeat a
doc_id are the same document given again (they don't remove each other); an empty table
gives an empty result; other columns of the input are ignored.  What is kept can cut a
multi-byte character, so it is returned as binary.
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
from trajectra.llm.rolling import BASE, Batch, powers

WINDOW = 100
ANCHOR = 20
#: Contexts of an anchor that one task sorts at most (about 2 KB each as arrays); an anchor with
#: more has each of its 81 windows told by a digest.
HOT_ROWS = 50_000
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _load(texts: list[str]) -> Batch:
    return Batch([np.frombuffer(t.encode(), dtype=np.uint8) for t in texts], np.uint8)


def _cutter(window: int, k: int):
    """For each anchor the bytes that its windows reach, and how many of them lie left of it."""
    reach = window - k

    def cut(texts: list[str], at: list[np.ndarray]) -> dict:
        around, lefts = [], []
        for text, positions in zip(texts, at):
            data = text.encode()
            for p in positions.tolist():
                a = max(0, p - reach)
                around.append(data[a : p + window])
                lefts.append(p - a)
        return {"around": around, "left": np.array(lefts, dtype=np.int32)}

    return cut


def _slices(texts: list[str], window: int):
    for text in texts:
        data = text.encode()
        yield len(data), lambda start, data=data: data[start : start + window]


class Suffixes:
    """Byte strings as rows of a matrix, with prefix polynomial hashes for comparing them."""

    def __init__(self, strings: list[bytes], width: int):
        n = len(strings)
        self.length = np.fromiter(map(len, strings), dtype=np.int64, count=n)
        self.bytes = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(n, width)
        self.prefix = np.zeros((n, width + 1), dtype=np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers(BASE, width), axis=1, out=self.prefix[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of rows a and b by binary search over prefix hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.length[a], self.length[b])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.prefix[a, middle] == self.prefix[b, middle]
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def checked(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """`most` cut back to the bytes that really agree."""
        differs = (self.bytes[a] != self.bytes[b]) & (np.arange(self.bytes.shape[1]) < most[:, None])
        return np.where(differs.any(axis=1), differs.argmax(axis=1), most)

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b; equal strings as `ties` says."""
        n = self.common(a, b)
        ended_a, ended_b = n == self.length[a], n == self.length[b]
        last = self.bytes.shape[1] - 1
        less = self.bytes[a, np.minimum(n, last)] < self.bytes[b, np.minimum(n, last)]
        return np.where(ended_a & ended_b, ties, np.where(ended_a, True, np.where(ended_b, False, less)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the rows by group (which ascends) and, within it, by suffix: a stable merge sort.

        Runs of all groups double together; every row finds its rank among its sibling run by
        binary search.
        """
        n = len(group)
        order = np.arange(n)
        if not n:
            return order
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.maximum.accumulate(np.where(fresh, order, 0))
        size = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1]
        run = 1
        while run < size.max():
            at = np.flatnonzero(size > run)
            local = at - first[at]
            mine, sibling = local // run, (local // run) ^ 1
            low = np.minimum(sibling * run, size[at])
            begin, high = low.copy(), np.minimum((sibling + 1) * run, size[at])
            right = mine > sibling  # equal strings of the left run stay in front
            own = order[at]
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                other = order[first[at[open_]] + middle]
                ahead = self.before(other, own[open_], right[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            moved = first[at] + np.minimum(mine, sibling) * run + (local - mine * run) + (low - begin)
            order[moved] = own
            run *= 2
        return order


def _classes(suffixes: Suffixes, group: np.ndarray):
    """A function of a length: numbers the rows of a group that agree in so many bytes (-1: too short)."""
    order = suffixes.sort(group)
    a, b = order[:-1], order[1:]
    extension = suffixes.checked(a, b, suffixes.common(a, b))
    extension = np.where(group[a] == group[b], extension, -1)

    def numbered(need: int) -> np.ndarray:
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(np.concatenate([[0], extension < need]))
        out[suffixes.length < need] = -1
        return out

    return numbered


def _comparer(window: int, k: int):
    reach = window - k

    def compare(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        around, left = frame["around"].tolist(), frame["left"].to_numpy()
        group = frame["key"].to_numpy()
        rights = _classes(Suffixes([s[n:] for s, n in zip(around, left)], window), group)
        lefts = _classes(Suffixes([s[:n][::-1] for s, n in zip(around, left)], reach), group)
        n = len(frame)
        doc, pos = frame["doc"].to_numpy(), frame["pos"].to_numpy()
        most, least = np.full(n, -1), np.full(n, window)
        for offset in range(reach + 1):
            x, y = lefts(offset), rights(window - offset)
            ok = np.flatnonzero((x >= 0) & (y >= 0))
            if not len(ok):
                continue
            # rows are in the order of doc and pos within a key: a class's first row is its earliest
            _, earliest, member = np.unique(x[ok] * (n + 1) + y[ok], return_index=True, return_inverse=True)
            first = ok[earliest][member]
            hit = ok[(doc[ok] != doc[first]) | (pos[ok] != pos[first])]
            most[hit] = np.maximum(most[hit], offset)
            least[hit] = np.minimum(least[hit], offset)
        return np.maximum(most, 0), np.where(most >= 0, window - least, 0)

    return compare


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """RESULT per row of docs(doc_id, text); see the module's docstring."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = plain.where(F.col("doc_id").isNotNull())
    spans = repeated_spans(known, _load, _cutter(window, anchor), partial(_slices, window=window), _comparer(window, anchor), "around binary, left int", window, anchor, across=False, most=HOT_ROWS)
    rows = known.join(spans, known["doc_id"] == spans["doc"], "left").select("doc_id", "text", "begins", "ends")
    nulls = plain.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<long>").alias("begins"), F.lit(None).cast("array<long>").alias("ends"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, begins, ends in zip(frame["text"], frame["begins"], frame["ends"]):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                gone = covered(begins, ends, len(data))
                kept = data[~gone].tobytes()
                spans_ = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
                out.append((len(data), int(gone.sum()), spans_, kept, hashlib.sha256(kept).hexdigest()))
            made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
            made.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield made

    return rows.unionByName(nulls).mapInPandas(run, RESULT)


def op6_substring_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(documents(spark, sf_dir)).drop("kept")


#: DuckDB's rows for op6: every 100-byte window by its digest, the first place of each, and what is left between the runs.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i, unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: md5(substr(h, 2 * i + 1, 200)))) AS s FROM d WHERE length(h) >= 200),
f AS (SELECT s, min(doc_id::HUGEINT * 10000000000 + i) AS k FROM w GROUP BY s),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id::HUGEINT * 10000000000 + i > k),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS fresh FROM r),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY doc_id, run),
v AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM u),
q AS (SELECT v.doc_id, sum(b - a)::BIGINT AS gone, count(*) AS runs, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS k, max(b) AS last FROM v JOIN d USING (doc_id) GROUP BY v.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE coalesce(k, '') || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)
"""
