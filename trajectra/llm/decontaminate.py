"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations alone.

Operator: `leaks`.  Texts are lower-cased and cut into words; a shingle is SHINGLE words and
weighs its number of characters.  A window is as many words of a document as an item has.

1. A window of similarity SIMILARITY shares shingles worth that share of the item's weight at
   least.  Documents meet the items' shingles, and running sums over the shared ones find every
   start whose window holds so much; no other window can be a leak.
2. Each such window and each item gets a 64-bit SimHash of its weighted shingles.
3. Fingerprints within RADIUS bits agree within RADIUS // BLOCKS bits in one of BLOCKS
   blocks; items are indexed under all values that near, so every pair within the radius meets.
4. A text of which a window meets an item is verified exactly, in all windows of that size:
   weighted Jaccard similarity of the shingle bags.

Copies of a text are handled once, by the text's hash.  Only the items' shingles and the
hashes of documents that share one are broadcast, each behind a count (BROADCAST_ROWS);
beyond it the joins shuffle.

Cases: a null or empty text holds no leak; items with fewer words than a shingle are found as
one shorter shingle of their own length; rows with null or repeated doc_ids are rows like
others; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectra.llm.common import documents, lowered, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 8
BROADCAST_ROWS = 1_000_000
SPACES = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def _shingles(words: Column, k: int) -> Column:
    """(hash, weight) of every run of k words, in order."""
    at = lambda i, j: F.get(words, i + F.lit(j))
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[at(i, j) for j in range(k)])),
    )


def _weight(words: Column, begin: Column, k: int) -> Column:
    return sum((F.length(F.get(words, begin + F.lit(j))) for j in range(1, k)), F.length(F.get(words, begin))) + F.lit(k - 1)


def _maybe_broadcast(small: DataFrame) -> DataFrame:
    """small with a broadcast hint if it has few enough rows."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def _fingerprints(bags: DataFrame, by: list[str]) -> DataFrame:
    """64-bit SimHash of the weighted shingle bags (by, hash, mass)."""
    sums = bags.groupBy(*by).agg(*[F.sum(F.when(F.shiftright("hash", b).bitwiseAND(F.lit(1)) == 1, F.col("mass")).otherwise(-F.col("mass"))).alias(f"b{b}") for b in range(64)], F.sum("mass").alias("total"))
    bits = [F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return sums.select(*by, "total", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("print"))


def _blocks(print_: Column, near: bool) -> Column:
    """(block, value) of a fingerprint; near: of all values that differ by RADIUS // BLOCKS bits or less."""
    width = 64 // BLOCKS
    masks = [m for m in range(1 << width) if m.bit_count() <= RADIUS // BLOCKS] if near else [0]
    part = lambda b: F.shiftrightunsigned(print_, b * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(b).alias("block"), part(b).bitwiseXOR(F.lit(m)).cast("int").alias("value")) for b in range(BLOCKS) for m in masks])


def _starts(shared: DataFrame, k: int, similarity: float) -> DataFrame:
    """text_key, size, start of all windows whose shared shingles have `similarity` of an item's weight.

    A shingle at pos enters the windows at start pos - size + k and leaves them after start
    pos, so their weight changes at these places alone and holds from one to the next.
    """
    turns = F.array(F.struct((F.col("pos") - F.col("size") + k).alias("at"), F.col("share").alias("change")), F.struct((F.col("pos") + 1).alias("at"), (-F.col("share")).alias("change")))
    order = Window.partitionBy("text_key", "size").orderBy("at")
    spans = shared.select("text_key", "size", F.explode(turns).alias("t")).select("text_key", "size", "t.*")
    spans = spans.select("text_key", "size", F.greatest("at", F.lit(0)).alias("first"), (F.lead("at").over(order) - 1).alias("last"), F.sum("change").over(order).alias("held"))
    # the sums are rounded, so a little less has to do
    return spans.where((F.col("held") >= similarity - 1e-6) & (F.col("first") <= F.col("last"))).select("text_key", "size", F.explode(F.sequence("first", "last")).alias("start"))


def leaks(docs: DataFrame, items: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start: the best window per row of docs and item it repeats."""
    item_words = items.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0).select("item_id", "words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(k)).alias("k"))
    sizes = [r["k"] for r in item_words.select("k").distinct().orderBy("k").collect()]  # at most k values
    found = None
    for own in sizes or [k]:
        part = _leaks(docs, item_words.where(F.col("k") == own), own, similarity)
        found = part if found is None else found.unionByName(part)
    return found


def _leaks(docs: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    text = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), _words(F.col("text")).alias("words"))
    places = items.select("item_id", "size", "words", F.posexplode(_shingles(F.col("words"), k)).alias("place", "hash"))
    item_bags = places.select("item_id", "size", "hash", _weight(F.col("words"), F.col("place"), k).alias("weight")).groupBy("item_id", "size", "hash").agg(F.count("*").alias("times"), F.max("weight").alias("weight"))
    item_bags = written(item_bags, "items")
    # a shingle's weight as a share of an item's whole weight, the largest over the items of a size
    whole = F.sum(F.col("weight") * F.col("times")).over(Window.partitionBy("item_id", "size"))
    wanted = item_bags.withColumn("share", F.col("weight") / whole).groupBy("hash", "size").agg(F.max("share").alias("share"))
    shared = text.select("text_key", F.posexplode(_shingles(F.col("words"), k)).alias("pos", "hash"))
    shared = shared.join(_maybe_broadcast(wanted), "hash").select("text_key", "size", "pos", "share").distinct()
    windows = written(_starts(shared, k, similarity), "windows")
    keys = windows.select("text_key").distinct()
    own = text.join(_maybe_broadcast(keys), "text_key", "left_semi").groupBy("text_key").agg(F.first("words").alias("words"))
    cut = own.join(windows.groupBy("text_key").agg(F.collect_list(F.struct("size", "start")).alias("windows")), "text_key")
    cut = cut.select("text_key", "words", F.explode("windows").alias("w")).select("text_key", F.col("w.size").alias("size"), F.col("w.start").alias("start"), F.slice("words", F.col("w.start") + 1, F.col("w.size")).alias("words"))
    rows = cut.select("text_key", "size", "start", "words", F.posexplode(_shingles(F.col("words"), k)).alias("place", "hash"))
    bags = rows.select("text_key", "size", "start", "hash", _weight(F.col("words"), F.col("place"), k).alias("weight")).groupBy("text_key", "size", "start", "hash").agg(F.count("*").alias("times"), F.max("weight").alias("weight"))
    bags = written(bags.withColumn("mass", F.col("weight") * F.col("times")), "bags")
    prints = written(_fingerprints(bags, ["text_key", "size", "start"]), "prints")
    item_mass = item_bags.withColumn("mass", F.col("weight") * F.col("times"))
    item_prints = _fingerprints(item_mass, ["item_id", "size"])
    left = prints.select("text_key", "size", "print", F.explode(_blocks(F.col("print"), False)).alias("b")).select("text_key", "size", "print", "b.*").distinct()
    right = item_prints.select("item_id", "size", F.col("total").alias("item_total"), F.col("print").alias("item_print"), F.explode(_blocks(F.col("print"), True)).alias("b")).select("item_id", "size", "item_total", "item_print", "b.*")
    near = left.join(right, ["size", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # a text with a window near an item is compared in all its windows, so that the best one counts
    pairs = near.select("text_key", "size", "item_id", "item_total").distinct().join(prints.select("text_key", "size", "start", "total"), ["text_key", "size"])
    # exact weighted-shingle similarity of the pairs
    both = pairs.join(bags, ["text_key", "size", "start"]).join(item_bags.select("item_id", "hash", F.col("times").alias("item_times")), ["item_id", "hash"])
    common = both.groupBy("text_key", "size", "start", "item_id", "total", "item_total").agg(F.sum(F.col("weight") * F.least("times", "item_times")).alias("common"))
    value = F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))
    best = common.withColumn("similarity", value).where(F.col("similarity") >= similarity).groupBy("text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    hits = best.select("text_key", "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.s")).alias("start"))
    named = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return named.join(hits, "text_key").select("doc_id", "item_id", "similarity", F.col("start").cast("int").alias("start"))


def op9_decontaminate_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB's rows for op9: every item-sized window that holds a shingle of an item, compared exactly.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
bp AS (SELECT item_id, len(w) AS size, least(len(w), 5) AS k, w, unnest(range(0, len(w) - least(len(w), 5) + 1)) AS q FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, size, k, q, array_to_string(w[q + 1:q + k], ' ') AS s FROM bp),
dp AS (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k),
ds AS (SELECT doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') AS s FROM dp),
sh AS (SELECT DISTINCT doc_id, k, size, p FROM ds JOIN (SELECT DISTINCT k, size, s FROM bs) USING (k, s)),
wins AS (SELECT DISTINCT doc_id, k, size, unnest(range(greatest(p - size + k, 0), p + 1)) AS start FROM sh),
ws AS (SELECT doc_id, k, size, start, s, count(*) AS t FROM wins JOIN ds USING (doc_id, k) WHERE p >= start AND p <= start + size - k GROUP BY ALL),
wt AS (SELECT doc_id, k, size, start, sum(t * length(s)) AS total FROM ws GROUP BY ALL),
bt AS (SELECT item_id, k, size, s, count(*) AS t FROM bs GROUP BY ALL),
it AS (SELECT item_id, sum(t * length(s)) AS total FROM bt GROUP BY ALL),
c AS (SELECT doc_id, item_id, start, k, ws.size, sum(length(s) * least(ws.t, bt.t)) AS common FROM ws JOIN bt USING (k, size, s) GROUP BY ALL),
v AS (SELECT doc_id, item_id, start, common / (wt.total + it.total - common) AS sim FROM c JOIN wt USING (doc_id, k, size, start) JOIN it USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) AS z FROM v WHERE sim >= 0.8)
SELECT doc_id, item_id, round(sim, 6) AS similarity, start::INTEGER AS start FROM r WHERE z = 1
"""
