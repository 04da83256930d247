"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run that counts has at least four periods, so it holds a square whose halves are squares
themselves (its root taken four times); only such squares are followed.

1. Over a batch of texts at once (numpy): suffixes are sorted by doubling, whose ranks also tell
   how far two places agree; the Lempel-Ziv blocks follow; each pair of neighbouring blocks
   gives the squares centred in the first, which cover the leftmost place of every square.
2. Texts that have one get a suffix tree, whose nodes' suffix links are walked: a square without
   its first word, followed by that word, is the next rotation, if the tree holds it.
   When no walk goes on, the tree knows the vocabulary: all such squares.
3. The leaves under a square are its places; places in a row with the same period are a run.

Operator: `periodic_runs`.  Cases: a null text, or one without words, has no runs; rows without
doc_id and repeated rows are rows like others; an empty table gives an empty result; other
columns are ignored.  A text is one row of its batch, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.llm.common import documents, in_batches

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words whose arrays a task holds at a time (a longer text is held alone).
CHUNK_WORDS = 200_000
#: (block, distance) pairs looked at together.
PAIRS = 1 << 20


class Sorted:
    """Texts of words as one array of codes, each followed by an end of its own, with its suffixes in order.

    levels[l] names the stretches of 2**l codes: equal names, equal stretches (which then lie in
    one text); after the last level all names differ.
    """

    def __init__(self, texts: list[list[bytes]]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + len(texts)
        of = np.repeat(np.arange(len(texts)), sizes + 1)
        codes = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.begins + sizes] = False
        names, words = pd.factorize(np.array([w for t in texts for w in t], dtype=object)) if sizes.sum() else (np.zeros(0, np.int64), [])
        codes[inner] = names + 1
        self.codes, self.n = codes, n
        key = of * (len(words) + 1) + codes
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order], open_ = self._heads(key[order], np.arange(n))
        self.levels, width = [rank.astype(np.int32)], 1
        while len(open_):
            at = order[open_]
            key = rank[at] * (n + 1) + rank[at + width]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[open_] = at
            heads, left = self._heads(key, open_)
            rank[at] = heads
            open_ = open_[left]
            width *= 2
            self.levels.append(rank.astype(np.int32))
        self.order, self.rank = order, rank

    @staticmethod
    def _heads(key: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first of each one's equals, indices of those with equals) of sorted keys."""
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new[:-1], np.arange(len(key)), 0))
        return places[head], np.flatnonzero(~(new[:-1] & new[1:]))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from a and from b on agree (a and b differ)."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], 1 << level
            same = (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)]) & (a < self.n) & (b < self.n)
            a += step * same
            b += step * same
            out += step * same
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes up to a and up to b, both included, agree."""
        a, b, out = a + 1, b + 1, np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], 1 << level
            same = (a >= step) & (b >= step)
            same &= rank[np.maximum(a - step, 0)] == rank[np.maximum(b - step, 0)]
            a -= step * same
            b -= step * same
            out += step * same
        return out

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks of all texts begin, and the end: each is the longest that began before, or one code."""
        rank = self.rank.tolist()
        above, below = list(range(1, self.n + 2)), list(range(-1, self.n))
        less, more = [0] * self.n, [0] * self.n
        # taken out from the last place on, a suffix has as neighbours the nearest in order that begin before it
        for i in range(self.n - 1, -1, -1):
            r = rank[i]
            lo, hi = below[r], above[r]
            less[i], more[i] = lo, hi
            if lo >= 0:
                above[lo] = hi
            if hi < self.n:
                below[hi] = lo
        longest = np.zeros(self.n, np.int64)
        for near in (np.array(less), np.array(more)):
            some = np.flatnonzero((near >= 0) & (near < self.n))
            longest[some] = np.maximum(longest[some], self.ahead(some, self.order[near[some]]))
        step, out, i = np.maximum(longest, 1).tolist(), [], 0
        while i < self.n:
            out.append(i)
            i += step[i]
        return np.array([*out, self.n], np.int64)

    def leading_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, half) of squares with square halves and a primitive root that cover the leftmost place of each such square."""
        at = self.blocks()
        h, h1, h2 = at[:-1], at[1:], np.append(at[2:], self.n)
        starts, halves = [], []
        # centred left of the border h1 and reaching over it, then those that reach back over h
        for base, most, forward in ((h1, h1 - h, False), (h, h2 - h, True)):
            upto = np.cumsum(most)
            begin = 0
            while begin < len(base):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS)))
                count = most[begin:end]
                block = np.repeat(np.arange(begin, end), count)
                k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
                border, q = base[block], base[block] + (k if forward else -k)
                # a square has an even half here; its first words beyond the border agree, or those before it do
                ok = np.flatnonzero((k % 2 == 0) & (border < self.n) & (q >= 0) & (q < self.n))
                ok = ok[self.codes[border[ok]] == self.codes[q[ok]]]
                border, q, k, block = border[ok], q[ok], k[ok], block[ok]
                right = self.ahead(border, q)
                left = np.zeros(len(ok), np.int64)
                inner = np.flatnonzero((border > 0) & (q > 0))
                left[inner] = self.behind(border[inner] - 1, q[inner] - 1)
                first = np.maximum((border if forward else q) - left, (border if forward else q) - k + 1)
                whole = (right > 0) & (left + right >= k)
                if forward:
                    whole &= (left > 0) & (first + k <= h1[block])
                starts.append(first[whole])
                halves.append(k[whole])
                begin = end
        start, half = np.concatenate(starts), np.concatenate(halves)
        fourth = self.ahead(start, start + half // 2) >= 3 * (half // 2)
        start, half = start[fourth], half[fourth]
        pairs = np.unique(np.stack([start, half]), axis=1)
        start, half = pairs[0], pairs[1]
        primitive = self._primitive(start, half // 2)
        return start[primitive], half[primitive]

    def _primitive(self, start: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the q words from each start on are no power of fewer."""
        sizes, of = np.unique(q, return_inverse=True)
        parts = [[size // p for p in _primes(size)] for size in sizes.tolist()]
        counts = np.array([len(x) for x in parts], np.int64)
        flat, begin, own = np.array([x for y in parts for x in y], np.int64), np.cumsum(counts) - counts, counts[of]
        pair = np.repeat(np.arange(len(start)), own)
        part = flat[np.repeat(begin[of] - np.cumsum(own) + own, own) + np.arange(len(pair))]
        power = self.ahead(start[pair], start[pair] + part) >= q[pair] - part
        out = np.ones(len(start), bool)
        out[pair[power]] = False
        return out


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


class Tree:
    """The suffix tree of one text (codes with an end of its own) from its suffixes in order.

    Node 0 is the root; a node's depth, first leaf and last leaf are places in the order.
    """

    def __init__(self, codes: list[int], order: list[int], common: list[int]):
        self.codes, self.order = codes, order
        n = len(codes)
        self.depth, self.parent, self.low, self.high, self.child = [0], [0], [0], [n], {}
        self.leaf = [0] * n
        path = [0]
        for i in range(n):
            last, shared = -1, common[i] if i else 0
            while self.depth[path[-1]] > shared:
                last = path.pop()
                self.high[last] = i
            top = path[-1]
            if self.depth[top] < shared:  # splits the edge to `last`
                made = self._node(shared, top, self.low[last])
                self.parent[last] = made
                self.child[made, codes[order[self.low[last]] + shared]] = last
                path.append(made)
                top = made
            leaf = self._node(n - order[i], top, i)
            self.leaf[order[i]] = leaf
            path.append(leaf)
        for v in path:
            self.high[v] = n
        self.link: dict[int, int] = {0: 0}

    def _node(self, depth: int, parent: int, low: int) -> int:
        self.depth.append(depth)
        self.parent.append(parent)
        self.low.append(low)
        self.high.append(low + 1)
        made = len(self.depth) - 1
        self.child[parent, self.codes[self.order[low] + self.depth[parent]]] = made
        return made

    def down(self, v: int, at: int, depth: int) -> int:
        """The node at or below whose edge the `depth` words from `at` on end, from v upwards on their path."""
        while self.depth[v] < depth:
            v = self.child[v, self.codes[at + self.depth[v]]]
        return v

    def linked(self, v: int) -> int:
        """The node of v's words without the first, for an inner node v."""
        todo = []
        while v not in self.link:
            todo.append(v)
            v = self.parent[v]
        for u in reversed(todo):
            up = self.parent[u]
            at = self.order[self.low[u]] + 1
            self.link[u] = self.down(self.link[up], at, self.depth[u] - 1)
        return self.link[todo[0]] if todo else self.link[v]

    def rotations(self, pairs: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """(node, length) of all squares that walks from those (start, length) reach; each ends on the edge to its node."""
        marked: set[tuple[int, int]] = set()
        for start, length in pairs:
            v = self.leaf[start]
            while self.depth[self.parent[v]] >= length:
                v = self.parent[v]
            while (v, length) not in marked:
                marked.add((v, length))
                at = self.order[self.low[v]]
                word = self.codes[at]
                v = self.down(self.linked(self.parent[v]), at + 1, length - 1)
                if self.depth[v] == length - 1:
                    v = self.child.get((v, word), -1)
                elif self.codes[self.order[self.low[v]] + length - 1] != word:
                    v = -1
                if v < 0:
                    break
        return marked


def runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text its runs as rows of (start, length, period), by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if not any(texts):
        return [none] * len(texts)
    batch = Sorted(texts)
    start, half = batch.leading_squares()
    out = [none] * len(texts)
    of = np.searchsorted(batch.begins, start, side="right") - 1
    for k in np.unique(of).tolist():
        begin, own = int(batch.begins[k]), of == k
        n = len(texts[k]) + 1
        rank = np.sort(batch.rank[begin : begin + n])
        order = batch.order[rank]
        common = np.zeros(n, np.int64)
        common[1:] = batch.ahead(order[:-1], order[1:])
        order = order - begin
        tree = Tree(batch.codes[begin : begin + n].tolist(), order.tolist(), common.tolist())
        found = tree.rotations([(int(s) - begin, 2 * int(x)) for s, x in zip(start[own], half[own])])
        places = [order[tree.low[v] : tree.high[v]] for v, _ in found]
        period = np.repeat([length // 4 for _, length in found], [len(p) for p in places])
        at = np.concatenate(places)
        by = np.lexsort((at, period))
        at, period = at[by], period[by]
        new = np.ones(len(at), bool)
        new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
        rows = np.stack([at[first], at[last] - at[first] + LEAST_PERIODS * period[first], period[first]], axis=1)
        rows = rows[rows[:, 1] >= LEAST_WORDS]
        out[k] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return out


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """words without those that a run has after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (kept words joined by a space) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, words, held = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                words.append(text.as_py().split())  # of bytes: at the six white-space characters of ASCII
                held += len(words[-1]) + 1
                if held >= CHUNK_WORDS or i + 1 == batch.num_rows:
                    found = runs(words)
                    offsets = np.zeros(len(found) + 1, np.int32)
                    np.cumsum([len(x) for x in found], out=offsets[1:])
                    flat = np.concatenate(found)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(flat.T)], fields=list(_RUN)))
                    kept = pa.array([b" ".join(collapsed(w, x)) for w, x in zip(words, found)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(words)), pa.array([len(w) for w in words], pa.int64()), lists, kept], names=["doc_id", "n_words", "runs", "collapsed"])
                    begin, words, held = i + 1, [], 0

    rows = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, RESULT)


def repeated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), of which about a tenth end in a repeated stretch of words, by the checksum of doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h_"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.greatest(F.size("words_"), F.lit(1)), F.floor(F.col("h_") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    turned = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words_", place(i))), " ")
    rows = rows.withColumn("words_", F.when(F.col("h_") % 10 == 0, words))
    return rows.select("doc_id", F.when((F.col("h_") % 10 == 0) & (F.size("words_") > 0), turned).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(repeated(documents(spark, sf_dir)))
    best = F.array_sort(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    best = F.get(best, F.lit(0))
    length, period = -best["col1"], best["period"]
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: The same by runs of equal words at each distance, which four equal words at that distance lead to.
SQL = r"""
WITH bytes AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT) AS b FROM documents),
crc AS (SELECT doc_id, text, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(b, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM bytes),
w0 AS (SELECT row_number() OVER () AS row, doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM crc),
w1 AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM w0),
w2 AS (SELECT row, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM w1),
p AS (SELECT row, n, unnest(range(0, n - 3)) AS i, unnest(list_transform(range(1, n - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w2 WHERE n >= 6),
q AS (SELECT x.row, x.i, y.i - x.i AS q FROM p x JOIN p y ON x.row = y.row AND x.s = y.s AND x.i < y.i AND (y.i - x.i) * 4 <= x.n),
j AS (SELECT row, q, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k, i FROM q),
r0 AS (SELECT row, q, min(i) AS s, max(i) - min(i) + 4 + q AS l FROM j GROUP BY row, q, k),
r1 AS (SELECT * FROM r0 WHERE l >= greatest(6, 4 * q)),
r AS (SELECT * FROM r1 a WHERE NOT EXISTS (SELECT 1 FROM r1 b WHERE b.row = a.row AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
d AS (SELECT DISTINCT row, unnest(range(s + q, s + l)) AS i FROM r),
k AS (SELECT row, string_agg(v, ' ' ORDER BY i) AS kept FROM (SELECT row, unnest(range(0, n)) AS i, unnest(w) AS v FROM w2) u WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.row = u.row AND d.i = u.i) GROUP BY row),
m AS (SELECT row, count(*) AS n_runs, arg_min([s, l, q], (-l, s, q)) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY row)
SELECT w2.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
 sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w2 LEFT JOIN m USING (row) LEFT JOIN k USING (row)
"""
