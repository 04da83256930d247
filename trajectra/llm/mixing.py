"""Mixing sources to target weights by min-cost flow over membership patterns.

Operator: `mix`.  A document may belong to several sources; documents with the same set of
sources form a membership pattern.  Word capacity is summed per pattern, and a min-cost flow
routes it to the sources' quotas: pattern -> source where the pattern has that source, source
-> sink up to its quota.  Using a pattern's words for the k-th time costs k, so repetition
costs are convex and a pattern is repeated only when the fresh words that could serve the
quota are used up.  Seeded documents of each pattern then take up what the flow gives it: all
of them `base` times, and those first in a seeded order once more, as long as they fit.  What
the first one that doesn't fit leaves open goes to the largest documents that still do, in
FILLS steps, so a source stays below its target by less than a small document.

Only pattern totals reach the driver, at most MAX_PATTERNS of them (more raise an error).
The seeded order is cut by two levels of hash histograms, so no task sorts a whole source.

Cases: a null text has size 0; a null source is a source of its own, ordered last; rows with
null or repeated doc_ids are rows like others; a document of size 0 takes nothing; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from trajectra.llm.common import WORD, documents, dropped, written

#: Most distinct membership patterns that a plan may have; the flow runs on the driver.
MAX_PATTERNS = 500_000
MAX_REPEAT = 3
SEED = 20240229
#: Parts into which each level of the seeded order cuts a pattern.
PARTS = 1024
#: Documents that fill what is left of a pattern behind the seeded order.
FILLS = 4


def quotas(sizes: dict, weights: dict, share: float = 1.0, most: float = MAX_REPEAT) -> dict:
    """Target words per source: weighted shares of all words, none above `most` times its own.

    What a source can't take is shared again by weight among the others until none is above.
    """
    total = share * sum(sizes.values())
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    rest = total
    while open_ and rest > 0:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if rest * weights[s] / weight >= most * sizes[s]}
        if not full:
            target |= {s: rest * weights[s] / weight for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        rest -= sum(target[s] for s in full)
        open_ -= full
    return target


def routed(capacity: dict[tuple, int], quota: dict, most: int = MAX_REPEAT) -> dict[tuple, dict]:
    """Words of every pattern that flow to each of its sources, at the least repetition cost.

    The cost of a path is that of its pattern's current tier, so opening tiers one after
    another and filling each up is a min-cost flow by successive shortest paths.  A tier is
    filled by blocking flows: words go to sources with room, then along the layers in which
    sources can hand words of some pattern on to another source.
    """
    patterns, sources = list(capacity), list(quota)
    place = {s: i for i, s in enumerate(sources)}
    edges = [[place[s] for s in p if s in place] for p in patterns]
    by_source: list[list[int]] = [[] for _ in sources]
    for p, own in enumerate(edges):
        for s in own:
            by_source[s].append(p)
    flow = [dict.fromkeys(own, 0) for own in edges]
    room = [round(quota[s]) for s in sources]

    def layers(begin: set[int]) -> dict[int, int] | None:
        """Steps from the sources of begin, up to the first layer in which one has room."""
        level, now, depth = dict.fromkeys(begin, 0), begin, 0
        while now and not any(room[s] for s in now):
            depth, after = depth + 1, set()
            for s in now:
                for q in by_source[s]:
                    if flow[q][s]:
                        after.update(t for t in edges[q] if t not in level)
            level |= dict.fromkeys(after, depth)
            now = after
        return level if now else None

    def onward(s: int, amount: int, level: dict[int, int], at: dict[int, tuple[int, int]]) -> int:
        """Words, at most amount, for which room is made in s by handing words on.

        A path goes from source to source down the layers; at says from which pattern and
        target on a source can still hand words on.
        """
        given, path = 0, []
        while given < amount:
            now = path[-1][2] if path else s
            if room[now]:
                moved = min([amount - given, room[now], *(flow[q][u] for u, q, _ in path)])
                for u, q, t in path:
                    flow[q][u] -= moved
                    flow[q][t] += moved
                room[now] -= moved
                given += moved
                # back to the first source that has no more to hand on, or to the last but one
                empty = next((k for k, (u, q, _) in enumerate(path) if not flow[q][u]), len(path) - 1)
                path = path[: max(empty, 0)]
                continue
            i, j = at[now]
            found = None
            while i < len(by_source[now]) and found is None:
                q = by_source[now][i]
                while flow[q][now] and j < len(edges[q]) and found is None:
                    t = edges[q][j]
                    if level.get(t) == level[now] + 1 and (room[t] or at[t][0] < len(by_source[t])):
                        found = t
                    else:
                        j += 1
                if found is None:
                    i, j = i + 1, 0
            at[now] = (i, j)
            if found is not None:
                path.append((now, by_source[now][i], found))
            elif path:
                path.pop()  # nothing goes on from here: its arcs are used up, so it is passed over
            else:
                break
        return given

    for _ in range(most):
        left = [capacity[p] for p in patterns]
        while level := layers({s for p, n in enumerate(left) if n for s in edges[p]}):
            at = dict.fromkeys(level, (0, 0))
            for p, own in enumerate(edges):
                for s in own if left[p] else ():
                    if level.get(s) == 0 and left[p]:
                        given = onward(s, left[p], level, at)
                        flow[p][s] += given
                        left[p] -= given
    return {p: {sources[s]: v for s, v in flow[i].items()} for i, p in enumerate(patterns)}


def _cut(rows: DataFrame, plan: DataFrame, part: str) -> DataFrame:
    """plan with the part in which its remaining words run out, and the words still open there.

    plan: pattern, rest.  Every part before `cut` is taken whole.
    """
    sums = rows.groupBy("pattern", F.col(part).alias("part")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("end", F.sum("words").over(upto)).join(F.broadcast(plan), "pattern")
    return ends.where(F.col("end") > F.col("rest")).groupBy("pattern").agg(
        F.min("part").alias("cut"), F.min(F.struct("part", (F.col("rest") - F.col("end") + F.col("words")).alias("open")))["open"].alias("open")
    )


def _fills(marked: DataFrame) -> DataFrame:
    """row, fill: the documents that fill what the seeded order left open, FILLS of a pattern at most."""
    spark = marked.sparkSession
    taken = marked.groupBy("pattern").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))), F.lit(0))).alias("open"))
    left = {r["pattern"]: r["open"] for r in taken.where("open > 0").collect()}  # at most MAX_PATTERNS
    fills: list[int] = []
    for _ in range(FILLS):
        if not left:
            break
        open_ = spark.createDataFrame(list(left.items()), "pattern string, open long")
        done = spark.createDataFrame([(f,) for f in fills], "row long")
        free = marked.where("not more and size > 0").join(F.broadcast(open_), "pattern").where("size <= open").join(F.broadcast(done), "row", "left_anti")
        best = free.groupBy("pattern").agg(F.max(F.struct("size", "u", "doc_id", "row")).alias("b")).select("pattern", "b.size", "b.row").collect()
        fills += [r["row"] for r in best]
        left = {r["pattern"]: left[r["pattern"]] - r["size"] for r in best if left[r["pattern"]] > r["size"]}
    return spark.createDataFrame([(f, True) for f in fills], "row long, fill boolean")


def mix(docs: DataFrame, membership: Column, weights=None, share: float = 1.0, most: int = MAX_REPEAT, seed: int = SEED, size: Column | None = None) -> tuple[DataFrame, list[tuple]]:
    """The mix as (row per document: doc_id, pattern, size, repeats, taken; quotas).

    membership: array<string> column with the sources of a document.  weights: source ->
    weight for a list of sources in order; default 1, 2, 3 repeating by code point, null last.
    quotas: (source, words there are, target, words routed) per source.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    order = F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    sized = docs.select(
        "doc_id",
        F.to_json(F.array_sort(F.array_distinct(membership))).alias("pattern"),
        words.alias("size"),
        order.alias("u"),
        F.pmod(order, F.lit(PARTS)).cast("int").alias("part"),
        F.pmod(F.shiftright(order, 20), F.lit(PARTS)).cast("int").alias("finer"),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = written(sized, "sized")
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge small sources first")
    capacity = {tuple(json.loads(r["pattern"])): int(r["words"]) for r in totals}
    named = {tuple(json.loads(r["pattern"])): r["pattern"] for r in totals}
    sources = sorted({s for p in capacity for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(c for p, c in capacity.items() if s in p) for s in sources}
    weight = (weights or (lambda names: {s: i % 3 + 1 for i, s in enumerate(names)}))(sources)
    target = quotas(sizes, weight, share, most)
    flow = routed(capacity, target, most)
    given = {p: sum(v.values()) for p, v in flow.items()}
    plan = spark.createDataFrame(
        [(named[p], given[p] // c if c else 0, given[p] % c if c else 0) for p, c in capacity.items()], "pattern string, base long, rest long"
    )
    first = _cut(sized, plan.select("pattern", "rest"), "part").withColumnsRenamed({"cut": "cut1", "open": "open1"})
    inside = sized.join(F.broadcast(first), "pattern").where(F.col("part") == F.col("cut1"))
    second = _cut(inside, first.select("pattern", F.col("open1").alias("rest")), "finer").withColumnsRenamed({"cut": "cut2", "open": "open2"})
    cuts = plan.join(first, "pattern", "left").join(second, "pattern", "left")
    rows = sized.join(F.broadcast(cuts), "pattern")
    # parts before the cut are in; in the last part documents follow as long as they fit
    before = (F.col("part") < F.col("cut1")) | (F.col("part") == F.col("cut1")) & (F.col("finer") < F.col("cut2"))
    edge = (F.col("part") == F.col("cut1")) & (F.col("finer") == F.col("cut2"))
    upto = Window.partitionBy("pattern").orderBy("u", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    chosen = rows.where(edge).withColumn("end", F.sum("size").over(upto)).withColumn("more", F.col("end") <= F.col("open2")).drop("end")
    plain = rows.where(~F.coalesce(edge, F.lit(False))).withColumn("more", F.coalesce(before, F.lit(False)))
    marked = written(plain.unionByName(chosen).select("doc_id", "pattern", "size", "u", "row", "base", "rest", "more"), "marked")
    fills = _fills(marked)
    more = F.col("more") | F.col("fill").isNotNull()
    repeats = F.when(F.col("size") > 0, F.least(F.col("base") + more.cast("long"), F.lit(most))).otherwise(F.lit(0)).cast("int")
    filled = marked.join(F.broadcast(fills), "row", "left")
    mixed = filled.select("doc_id", "pattern", "size", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))
    dropped(sized)
    routed_to = {s: sum(v.get(s, 0) for v in flow.values()) for s in sources}
    return mixed, [(s, sizes[s], float(target[s]), routed_to[s]) for s in sources]


def op1_mixing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, quota = mix(documents(spark, sf_dir), F.array("source"))
    facts = spark.createDataFrame([(json.dumps([s], separators=(",", ":"), ensure_ascii=False), s, n, t) for s, n, t, _ in quota], "pattern string, source string, source_size long, target double")
    return mixed.join(F.broadcast(facts), "pattern").select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")
