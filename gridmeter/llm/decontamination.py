"""Benchmark decontamination by SimHash over item-sized windows. DataFrame operations only.

Documents are compared with benchmark items by k-word shingles (a shorter item is one shingle), weighted
by ln(1 + items / items with the shingle), in hundredths; shingles of no item weigh nothing. A document holds
an item if a window of the item's length has at least `similarity` of the item's weight.

1. Windows: for every shingle of a document that items of some length have, the window of that length which
   starts there. No other window need be looked at: one that holds an item starts no later than its first
   shingle of the item, and moved on to that it keeps all of them. Windows know lengths, not items.
2. SimHash: 64 signed weight sums give each distinct window content and each item a fingerprint. At a
   similarity of 0.8 they differ in 9.5 bits, give or take 2.8.
3. Multi-index: fingerprints within RADIUS bits agree on at least one of RADIUS + 1 blocks, so joining
   windows with items on (length, block, value) meets all of them.
4. The exact weighted similarity decides.

A document is a doc_id with a text, an item an item_id with a text; window contents are compared once,
however many documents hold them.

Defined results: null texts hold nothing; an item without words matches nothing; a null doc_id or item_id is
kept as it is; of several windows of a doc_id that hold an item_id, the best and then the first is given; rows
that repeat a doc_id or item_id with other texts each count. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, materialize

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
_BLANK = "[ \\t\\n\\x0B\\f\\r]+"


def words(text: Column) -> Column:
    """Lower-case words; null where there are none."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare != "", F.split(bare, _BLANK))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that is computed once: no projection is merged across a generator, into a lambda's body say."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shingles(hashes: Column, n: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of word hashes of n >= k words."""
    return F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))))


def _fingerprint() -> list[Column]:
    """Sums of the weights whose shingles have a bit set, of two bits each, 32 bits apart, and the sum of all weights."""
    return [F.sum("weight").alias("held"), *(F.expr(f"sum(weight * (shiftrightunsigned(shingle, {b}) & 4294967297L)) AS b{b}") for b in range(32))]


def _joined() -> Column:
    """Of the 64 signed sums the signs: a bit is set where the weights that have it are more than half."""
    low = [f"IF(2 * (b{b} & 4294967295L) > held, {1 << b}L, 0L)" for b in range(32)]
    high = [f"IF(2 * shiftrightunsigned(b{b}, 32) > held, shiftleft(1L, {b + 32}), 0L)" for b in range(32)]
    return F.expr(f"({' | '.join(low + high)}) AS fingerprint")


def _blocks(radius: int) -> Column:
    """(block, value) of each of radius + 1 blocks of a fingerprint."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    cut = (f"named_struct('block', {i}, 'value', shiftrightunsigned(fingerprint, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return F.expr(f"explode(array({', '.join(cut)})) AS x")


def _item_shingles(items: DataFrame, k: int) -> tuple[DataFrame, dict[int, int]]:
    """item (a number), item_id, length (shingles), k, shingle, weight of every distinct shingle of every item; their number by k."""
    known = _once(items.select("item_id", words(F.col("text")).alias("w")).filter("w IS NOT NULL").distinct(), "h", F.transform("w", lambda x: F.xxhash64(x)))
    sized = known.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "w").alias("item"), "item_id", F.size("w").alias("size"), F.least(F.size("w"), F.lit(k)).alias("k"), "h")
    rows = None
    for j in range(1, k + 1):
        some = sized.filter(F.col("k") == j).select("item", "item_id", (F.col("size") - j + 1).alias("length"), "k", F.explode(F.array_distinct(_shingles(F.col("h"), F.col("size"), j))).alias("shingle"))
        rows = some if rows is None else rows.unionByName(some)
    rows = materialize(rows)
    known_k = rows.groupBy("k").agg(F.count("*").alias("marks"), F.countDistinct("item").alias("items")).collect()  # at most SHINGLE rows
    n = sum(r["items"] for r in known_k)
    df = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    weight = F.round(100 * F.log1p(F.lit(float(n)) / F.col("df"))).cast("long")
    return materialize(rows.join(df, "shingle").select("item", "item_id", "length", "k", "shingle", weight.alias("weight"))), {r["k"]: r["marks"] for r in known_k}


def _contents(docs: DataFrame, marks: DataFrame, sizes: list[int], few: bool) -> DataFrame | None:
    """doc_id, length, start, content (the distinct shingles of items in the window, ascending) of the windows of docs."""
    hashes = _once(docs.select("doc_id", "text"), "h", F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).select("doc_id", F.xxhash64("text").alias("text"), "h", F.size("h").alias("n"))
    lengths = marks.groupBy("k", "shingle").agg(F.collect_set("length").alias("lengths"))  # however many items share a shingle
    windows = None
    for j in sizes:
        own = lengths.filter(F.col("k") == j).drop("k")
        places = hashes.filter(F.col("n") >= j).select("doc_id", "text", F.posexplode(_shingles(F.col("h"), F.col("n"), j)).alias("pos", "shingle"))
        met = places.join(F.broadcast(own) if few else own, "shingle")
        by_text = met.groupBy("doc_id", "text").agg(F.sort_array(F.array_distinct(F.collect_list(F.struct("pos", "shingle", "lengths")))).alias("m"))
        by_text = by_text.select("doc_id", F.col("m.pos").alias("at"), F.col("m.shingle").alias("s"), F.posexplode("m").alias("i", "x"))
        ahead = by_text.select("doc_id", "at", "s", "i", F.col("x.pos").alias("start"), F.explode("x.lengths").alias("length"))
        # shingles stand at most one to a position, so the window's end is at most `length` marks ahead
        near = F.size(F.filter(F.slice("at", F.col("i") + 1, F.col("length")), lambda p: p < F.col("start") + F.col("length")))
        cut = ahead.select("doc_id", "length", "start", F.lit(j).alias("k"), F.sort_array(F.array_distinct(F.slice("s", F.col("i") + 1, near))).alias("content"))
        windows = cut if windows is None else windows.unionByName(cut)
    return windows


def contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (word, from 0), distance (bits), similarity of every document of docs (doc_id, text) that holds an item of items (item_id, text)."""
    marks, sizes = _item_shingles(items, k)
    few = sum(sizes.values()) <= BROADCAST_ROWS // 4
    found = _contents(docs, marks, sorted(sizes), few)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start int, distance int, similarity double")
    totals = marks.groupBy("item", "length", "k").agg(F.sum("weight").alias("total"))
    least = totals.groupBy("length", "k").agg(F.min("total").alias("least"))
    weights = marks.select("k", "shingle", "weight").distinct()
    small = lambda df: F.broadcast(df) if few else df
    windows = materialize(found, adaptive=not few)
    distinct = windows.select("length", "k", "content").distinct().withColumn("window", F.xxhash64("length", "k", "content"))
    tokens = distinct.select("window", "length", "k", F.explode("content").alias("shingle")).join(small(weights), ["k", "shingle"])
    summed = tokens.groupBy("window", "length", "k").agg(*_fingerprint())
    heavy = summed.join(small(least), ["length", "k"]).filter(F.col("held") >= F.lit(similarity) * F.col("least"))  # lighter windows hold no item of their length
    prints = marks.groupBy("item", "item_id", "length", "k").agg(*_fingerprint()).select("item", "item_id", "length", "k", F.col("held").alias("total"), _joined())
    left = heavy.select("window", "length", "k", "held", _joined()).select("window", "length", "k", "held", "fingerprint", _blocks(radius)).select("window", "length", "k", "held", "fingerprint", "x.*")
    right = prints.select("item", "item_id", "total", "length", "k", "fingerprint", _blocks(radius)).select("item", "item_id", "total", "length", "k", F.col("fingerprint").alias("own"), "x.*")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("own")))
    near = left.join(small(right), ["length", "k", "block", "value"]).filter(F.col("held") >= F.lit(similarity) * F.col("total"))  # no window shares more with an item than it holds
    near = materialize(near.select("window", "item", "item_id", "total", distance.alias("distance")).filter(F.col("distance") <= radius).distinct(), adaptive=not few)
    met = near.select("window", "item", "item_id", "total", "distance").join(tokens.select("window", "shingle", "weight"), "window")  # the candidates' shingles only
    shared = met.join(small(marks.select("item", "shingle")), ["item", "shingle"]).groupBy("window", "item", "item_id", "total", "distance").agg(F.sum("weight").alias("shared"))
    held = shared.withColumn("similarity", F.col("shared") / F.col("total")).filter(F.col("similarity") >= similarity)
    both = windows.select("doc_id", "start", F.xxhash64("length", "k", "content").alias("window")).join(held.select("window", "item_id", "distance", "similarity"), "window")
    best = both.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("start", "distance", "similarity"), F.struct(-F.col("similarity"), "start", "distance")).alias("x"))
    return best.select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold an item."""
    bad = contaminated(docs, items).select("doc_id").distinct()
    return docs.alias("d").join(bad.alias("b"), F.expr("d.doc_id <=> b.doc_id"), "left_anti")
