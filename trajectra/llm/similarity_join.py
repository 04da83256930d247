"""Exact Jaccard join of documents on word n-grams by universe partition and pigeonhole.

Operator: `near_duplicates`.  A document's set holds the hashes of its distinct k-word
shingles; two documents link if their sets' Jaccard similarity reaches percent/100.

Sets are banded by size.  In a band's level the universe of hashes is cut into segments.
Linked sets differ in at most H elements (H follows from the level's largest sizes), so the
segments cover H + 1 + slack units: a segment indexed by its exact subset covers one unit, one
indexed by its subset and all its one-deletion neighbours covers two.  A level's allocation
between the two kinds is the cheapest by the cost model of `allocation`.  Linked sets then
agree on segments worth slack + 1 units or more, so at least on one that isn't empty unless
more than `slack` units of both sets are empty; those few sets also index their prefix (the
least elements of which linked sets must share one).

Sets that share a key are candidates.  Keys with the same sets count as one, with their number
as its weight, which folds the many keys that a pair of near copies shares.  Of each key the
most central set (whose keys are shared most) comes first; each set is first compared exactly
with the first set of the keys that it shares most of.  A round then compares one pair of sets
for each two components that meet in a key, and at last, for keys whose sets are still not in
one component, all sets of different components, once for all keys that two sets share.
Before sets are compared exactly, a bound from parity sketches prunes: every bit in which two
of them differ stands for an element that only one set has.  No links are lost, and a group of
a thousand near copies costs a thousand comparisons.  Copies are one set throughout.  A set is
named by a 64-bit hash of its elements, a word by a hash that chains its letters (see rolling).

Cases: a null text or one without words has an empty set and links with nothing; a text of
fewer than k words is one shingle; texts of any length are read whole; rows with null or
repeated doc_ids are rows like others (nulls never name a component unless no other id is in
it); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectra.llm.common import broadcast_if_small, chunks, documents, dropped, in_batches, written
from trajectra.llm.components import components
from trajectra.llm.rolling import mix, tuple_hashes, words_of

WORDS, PERCENT = 4, 85
#: Ratio of the sizes of a band.
BAND = 1.42
#: 64-bit numbers of a parity sketch (twice as many for each doubling of a set above as many
#: elements as bits), and of the sketch folded for joins by key.
SKETCH, FOLDED = 32, 8
#: Least keys of a set that tell in the last comparison whether a pair met in a lesser key.
LOW_KEYS = 16
#: Index entries up to which tables of their keys or sets are broadcast.
FEW = 2_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@lru_cache
def bands(percent: int) -> list[int]:
    """First sizes of the bands, up to 2**31."""
    first = [1]
    while first[-1] < 1 << 31:
        least = first[-1] * 100 // percent + 1  # linked sizes then lie in neighbouring bands
        first.append(max(least, int(first[-1] * BAND)))
    return first


@lru_cache
def allocation(level: int, percent: int) -> tuple[int, int, int, int]:
    """(exact segments, one-deletion segments, slack, H) of a level.

    Cost of a set: its keys, and for every segment the chance that it is short, which makes
    candidates that share little else.
    """
    first = bands(percent)
    low, high = first[level], first[level + 1] - 1
    most = high * (100 - percent) // percent
    best = None
    for deletions in {0, (most + 1) // 4, (most + 1) // 2, (most + 2) // 2} if most <= 400 else {0}:
        slack = 0
        while True:
            exact = max(0, most + 1 + slack - 2 * deletions)
            segments = exact + deletions
            mean = low / segments
            empty = exact * math.exp(-mean) + 2 * deletions * math.exp(-mean) * (1 + mean)
            if segments == 1 or slack >= empty + 2.5 * math.sqrt(empty) or slack > most + 8:
                break
            slack += 1
        size = math.sqrt(low * high)
        cost = exact + deletions * (1 + size / segments) + 8 * segments * math.exp(-size / segments)
        if best is None or cost < best[0]:
            best = (cost, exact, deletions, slack, most)
    return best[1:]


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, sizes): the sorted distinct shingle hashes of every text, laid end to end."""
    batch = words_of([t.encode().translate(_LOWER) for t in texts])[0]
    grams = tuple_hashes(batch.units, k)
    owner, room = batch.owner(), batch.room()
    whole = np.flatnonzero(room >= k)
    element, doc = grams[-1][whole], owner[whole]
    for size in range(1, k):  # a shorter text is one shingle
        short = np.flatnonzero(batch.length == size)
        element = np.concatenate([element, mix(grams[size - 1][batch.start[short]] + np.uint64(size))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((element, doc))
    element, doc = element[order], doc[order]
    fresh = np.ones(len(element), bool)
    fresh[1:] = (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])
    return element[fresh], np.bincount(doc[fresh], minlength=len(texts))


def names(element: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set, from all its elements."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(element ^ np.uint64(0x5851F42D4C957F2D)))])
    end = np.cumsum(size)
    return mix(total[end] - total[end - size] + size.astype(np.uint64)).view(np.int64)


def signatures(element: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of every index entry; sets are numbered from 0."""
    first = np.array(bands(percent), dtype=np.int64)
    band = np.searchsorted(first, size, side="right") - 1
    start = np.cumsum(size) - size
    keys, sets = [], []
    for level in np.unique(np.concatenate([band, band - 1])).tolist():
        if level < 0:
            continue
        # the level's own band, and what of the next band can link into it
        high = int(first[level + 1] - 1)
        inside = np.flatnonzero((size > 0) & ((band == level) | (band == level + 1) & (size * percent <= high * 100)))
        if not len(inside):
            continue
        exact, deletions, slack, _ = allocation(level, percent)
        segments = exact + deletions
        n = size[inside]
        at = np.repeat(start[inside] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own, element_ = np.repeat(np.arange(len(inside)), n), element[at]
        segment = (mix(element_ ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(segments)).astype(np.int64)
        cell = own * segments + segment
        value = mix(element_ + np.uint64(level))
        content, count = np.zeros(len(inside) * segments, np.uint64), np.bincount(cell, minlength=len(inside) * segments)
        np.add.at(content, cell, value)
        salt = mix(np.arange(segments, dtype=np.uint64) + np.uint64(level << 32))
        full = np.flatnonzero(count)
        keys.append(mix(content[full] ^ salt[full % segments]))
        sets.append(inside[full // segments])
        if deletions:  # the last segments also index each subset less one element
            cut = np.flatnonzero((segment >= exact) & (count[cell] > 1))
            keys.append(mix((content[cell[cut]] - value[cut]) ^ salt[segment[cut]]))
            sets.append(inside[own[cut]])
        table = count.reshape(len(inside), segments)
        empty = (table[:, :exact] == 0).sum(axis=1) + 2 * (table[:, exact:] <= 1).sum(axis=1)
        for i in np.flatnonzero(empty > slack).tolist():
            some = element[start[inside[i]] : start[inside[i]] + n[i]]
            prefix = np.sort(mix(some))[: n[i] - -(-int(n[i]) * percent // 100) + 1]
            keys.append(mix(prefix ^ np.uint64(0xD1342543DE82EF95 ^ level)))
            sets.append(np.full(len(prefix), inside[i]))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(sets)


def sketches(element: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Per set, the parity of its number of elements in each class, as bits.

    The classes are a power of two, so the first half of a sketch XOR its second half is the
    sketch over half of them.
    """
    out = []
    mixed = mix(element)
    for a, b in zip(np.cumsum(size) - size, np.cumsum(size)):
        width = SKETCH * 64 << max(0, int(b - a - 1) // (SKETCH * 64)).bit_length()
        odd = np.bincount((mixed[a:b] % np.uint64(width)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return out


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _facts(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n, node, sketch per row of docs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in chunks(texts):
                element, size = shingle_sets(texts[a:b], k)
                yield pd.DataFrame({"id": frame["id"].to_numpy()[a:b], "text_key": frame["text_key"].to_numpy()[a:b], "n": size, "node": names(element, size), "sketch": sketches(element, size)})

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), _text_key())
    facts = rows.mapInPandas(run, "id string, text_key long, n long, node long, sketch array<long>")
    return facts.select(F.col("id").cast("long").alias("doc_id"), "text_key", "n", "node", "sketch")


def _fresh(size: np.ndarray, node: np.ndarray, seen: set[int]) -> np.ndarray:
    """Marks the sets that aren't empty and that the task has not met yet."""
    out = size > 0
    for i in np.flatnonzero(out).tolist():
        name = int(node[i])
        out[i] = name not in seen
        seen.add(name)
    return out


def _index(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """key, node: every set's index entries, those of copies once in a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            texts = list(dict.fromkeys(frame["text"]))
            for a, b in chunks(texts):
                element, size = shingle_sets(texts[a:b], k)
                node = names(element, size)
                fresh = _fresh(size, node, seen)
                element, size, node = element[np.repeat(fresh, size)], size[fresh], node[fresh]
                key, own = signatures(element, size, percent)
                yield pd.DataFrame({"key": key, "node": node[own]})

    return docs.where(F.col("text").isNotNull()).select("text").mapInPandas(run, "key long, node long")


def _elements(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, elements of the rows of docs that wanted(text_key, id) names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in chunks(texts):
                element, size = shingle_sets(texts[a:b], k)
                node = names(element, size)
                fresh = _fresh(size, node, seen)
                sets = np.split(element.view(np.int64), np.cumsum(size)[:-1])
                yield pd.DataFrame({"node": node[fresh], "elements": [s for s, f in zip(sets, fresh) if f]})

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", _text_key()).alias("d")
    w = broadcast_if_small(wanted).alias("w")
    rows = rows.join(w, (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.id")), "left_semi")
    return rows.select("text").mapInPandas(run, "node long, elements array<long>")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _near(x: Column, y: Column, n: Column, m: Column, percent: int, numbers: int = 0) -> Column:
    """Whether sets of n and m elements with these sketches (of as many numbers, if given) can reach the similarity."""
    if numbers:
        differ = reduce(lambda p, q: p + q, [F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(numbers)])
    else:  # linked sets differ in size by less than a doubling
        same = F.zip_with(_halved(x, y), _halved(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        differ = F.aggregate(same, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return _sizes_fit(n, m, percent) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _halved(sketch: Column, other: Column) -> Column:
    """The sketch over half of its classes if the other has fewer."""
    half = (F.size(sketch) / 2).cast("int")
    return F.when(F.size(sketch) > F.size(other), F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(sketch)


def _folded(sketch: Column) -> Column:
    """The parity sketch over FOLDED * 64 classes."""
    part = lambda i: F.filter(sketch, lambda v, j: j % FOLDED == i)
    return F.array(*[F.aggregate(part(i), F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v)) for i in range(FOLDED)])


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b, ...) of sets that reach the similarity: by folded and whole sketches, then by elements."""
    near = pairs
    for sketch, numbers in ((_folded(F.col("sketch")), FOLDED), (F.col("sketch"), 0)):
        known = nodes.select("node", sketch.alias("sketch"), "n")
        if near is not pairs:  # few are left: their sets alone move
            known = known.join(broadcast_if_small(ends), "node", "left_semi")
        both = near.join(known.toDF("a", "sx", "nx"), "a").join(known.toDF("b", "sy", "ny"), "b")
        last, near = near, written(both.where(_near(F.col("sx"), F.col("sy"), F.col("nx"), F.col("ny"), percent, numbers)).select(*pairs.columns), "near")
        dropped(*[last] if last is not pairs else [])
        ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = written(_elements(docs, nodes.join(broadcast_if_small(ends), "node", "left_semi").select("text_key", "id"), k), "elements")
    # the elements of b move to those of a, which are few: each set travels once
    one = sets.join(broadcast_if_small(near.select("a").distinct()), F.col("node") == F.col("a")).select("a", F.col("elements").alias("x"))
    two = sets.join(broadcast_if_small(near), F.col("node") == F.col("b")).select(*near.columns, F.col("elements").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    rows = two.join(one, "a").where(100 * common >= percent * (F.size("x") + F.size("y") - common))
    links = written(rows.select(*pairs.columns), "links")
    dropped(near, sets)
    return links


def _index_shared(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """key, node, weight: the sets of every key that several share; keys with the same sets are folded."""
    per_key = Window.partitionBy("key")
    # names are hashes, so the sums of their halves tell sets of sets apart
    dealt = _index(docs, k, percent).repartition("key").withColumns({"high": F.shiftrightunsigned("node", 32), "low": F.col("node").bitwiseAND(F.lit(0xFFFFFFFF))})
    facts = {"least": F.min("node"), "most": F.max("node"), "size": F.count("*"), "highs": F.sum("high"), "lows": F.sum("low")}
    shared = dealt.withColumns({c: f.over(per_key) for c, f in facts.items()}).where("least <> most")
    found = written(shared.select("key", "node", (F.col("node") == F.col("least")).alias("first"), F.xxhash64(*facts).alias("sets")), "found")
    kept = found.where("first").groupBy("sets").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    out = written(found.join(broadcast_if_small(kept.select("key", "weight")), "key").select("key", "node", "weight").dropDuplicates(["key", "node"]), "shared")
    dropped(found)
    return out


def _members(shared: DataFrame, nodes: DataFrame, small: Callable) -> DataFrame:
    """key, node, n, weight, central: shared with what the comparisons need of each set."""
    sizes = shared.groupBy("key").agg(F.count("*").alias("size"))
    # a set that shares popular keys stands in the middle of its group; it comes first in its keys
    central = shared.join(small(sizes), "key").groupBy("node").agg(F.sum(F.col("size") * F.col("weight")).alias("central"))
    return written(shared.join(small(central.join(small(nodes.select("node", "n")), "node")), "node"), "members")


def _stars(members: DataFrame, percent: int, small: Callable) -> DataFrame:
    """a, b: for every set one that comes first in keys of it, that which shares most of them."""
    first = members.groupBy("key").agg(F.max(F.struct("central", "node", "n")).alias("first")).select("key", F.col("first.node").alias("first"), F.col("first.n").alias("m"))
    met = members.join(small(first), "key").where((F.col("node") != F.col("first")) & _sizes_fit(F.col("n"), F.col("m"), percent))
    shared = met.groupBy("node", "first").agg(F.sum("weight").alias("keys"))
    return shared.groupBy("node").agg(F.max_by("first", F.struct("keys", "first")).alias("a")).select("a", F.col("node").alias("b"))


def _split(members: DataFrame, labels: DataFrame, small: Callable) -> DataFrame:
    """key, node, n, weight, central, label, main of the keys whose sets are in several components."""
    labelled = members.join(small(labels), "node")
    several = labelled.groupBy("key").agg(F.min("label").alias("main"), F.max("label").alias("most")).where("main <> most").select("key", "main")
    return written(labelled.join(small(several), "key"), "split")


def _meetings(split: DataFrame, small: Callable) -> DataFrame:
    """a, b, la, lb: a pair of sets for each two components that meet in a key beside its first one."""
    reps = split.groupBy("key", "label").agg(F.max(F.struct("central", "node", "weight")).alias("r")).select("key", "label", F.col("r.central").alias("central"), F.col("r.node").alias("b"), F.col("r.weight").alias("weight"))
    first = split.groupBy("key").agg(F.max(F.struct("central", "node", "label")).alias("f")).select("key", F.col("f.node").alias("a"), F.col("f.label").alias("la"))
    met = reps.withColumnRenamed("label", "lb").join(small(first), "key").where("lb <> la")
    pairs = met.groupBy("la", "lb", "a", "b").agg(F.sum("weight").alias("keys"))
    return pairs.groupBy("la", "lb").agg(F.max(F.struct("keys", "a", "b")).alias("p")).select("p.a", "p.b", "la", "lb")


def _remaining(split: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, la, lb: all pairs of different components in a key that their folded sketches don't rule out."""
    keys = split.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOW_KEYS).alias("low"))
    known = keys.join(nodes.select("node", _folded(F.col("sketch")).alias("sketch")), "node")
    told = written(split.select("key", "node", "n", "label", "main").join(known, "node"), "told")
    x, y = told.where("label <> main").alias("x"), told.alias("y")
    may = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    may &= _near(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"), percent, FOLDED)
    # a pair meets in every key that it shares; it is told by the least of them, where `low` shows it
    may &= F.coalesce(F.array_min(F.array_intersect("x.low", "y.low")), F.col("x.key")) >= F.col("x.key")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & may)
    pairs = written(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct(), "pairs")
    dropped(told)
    return pairs


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after joining the components (la, lb) of links."""
    moved = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("new"))
    out = written(labels.join(broadcast_if_small(moved), "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    dropped(labels, links)
    return out


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, label per row of docs(doc_id, text); see the module's docstring.

    text_key is the hash of the row's text.  label names the component also where no row of it
    has a doc_id; a row with an empty set has none.
    """
    docs = in_batches(docs)
    facts = written(_facts(docs, k), "facts")
    shared = _index_shared(docs, k, percent)
    few = shared.limit(FEW + 1).count() <= FEW
    small = lambda df: F.broadcast(df) if few else df  # noqa: E731  (tables with a row per key or per set of shared)
    row = F.min(F.struct("text_key", F.col("doc_id").alias("id"))).alias("row")
    nodes = facts.join(small(shared.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), row)
    nodes = written(nodes.select("node", "n", "sketch", "row.*"), "nodes")
    members = _members(shared, nodes, small)
    links = _verified(docs, _stars(members, percent, small), nodes, k, percent)
    labels = written(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    dropped(links, shared)
    split = _split(members, labels, small)
    labels = _merged(labels, _verified(docs, _meetings(split, small), nodes, k, percent))
    dropped(split)
    split = _split(members, labels, small)
    rest = _remaining(split, nodes, percent)
    labels = _merged(labels, _verified(docs, rest, nodes, k, percent))
    named = facts.groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(by_label, "label").select("node", "component_id", "label")
    joined = facts.where("n > 0").join(classes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key", "label")
    out = joined.unionByName(facts.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key", F.lit(None).cast("long").alias("label")))
    dropped(split, rest, members, nodes)
    return out


def op5_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


#: DuckDB's rows for op5: all pairs that share a shingle, then components.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM g UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM g JOIN m USING (doc_id)
"""
