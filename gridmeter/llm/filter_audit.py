"""How filters of documents interact: a histogram of failure masks answers for every order of the filters.

Each text gets a mask with a bit for each filter that it fails, in one pass of native expressions. Documents are
counted by part and mask, 32 cells a part at most, and whatever an order of the filters does follows from the cells:
a filter removes the documents of the cells that fail it and none before it.

Filters: A few words, B few distinct words, C many capitals, D marks, E the text of a smaller doc_id.
Texts are told apart by SHA-256; the least doc_id of each comes from a groupBy that sees a row for each text, part
and task at most, however many copies a text has.

Defined results: null text is empty, a null part is the empty string; documents without doc_id never fail E and
make none fail it; rows that repeat a doc_id are documents of their own, and equal texts of one doc_id don't fail E
by one another; a doc_id has a label where any of its label rows says so; labels without a document are ignored. No
documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_SPACE = " \t\n\x0b\f\r"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3, marks: str = "[#$%&*|]") -> Column:
    """The bits of the filters A to D, which a text fails by itself."""
    inner = F.btrim(text, F.lit(_SPACE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))
    few = F.size(words) < least_words
    alike = 100 * F.size(F.array_distinct(words)) < distinct_percent * F.size(words)
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > capital_percent * F.length(text)
    return sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate((few, alike, loud, text.rlike(marks)))), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", **limits) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each cell, those of quality 1 and the toxic ones among them."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text, **limits).alias("bits"))
    each = each.groupBy("digest", "doc_id", "part", "bits").agg(F.count("*").alias("n"))
    marked = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    # documents without an id are spread, as no label is theirs
    salted = each.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    known = salted.join(marked.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    good, toxic = (F.col("n") * F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic"))
    first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", good.alias("good"), toxic.alias("toxic")))
    texts = known.groupBy("digest", "part", "bits").agg(F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"), F.min(first).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row for each part that has the text
    own = F.col("first.doc_id") == F.col("least")
    spared = {"n": F.when(own, F.col("first.n")).otherwise(0) + F.col("unnamed")} | {c: F.when(own, F.col(f"first.{c}")).otherwise(0) for c in ("good", "toxic")}
    e_bit = 1 << FILTERS.index("E")
    cells = lambda mask, of: F.struct(mask.alias("mask"), *(of[c].alias(c) for c in ("n", "good", "toxic")))
    split = F.array(cells(F.col("bits"), spared), cells(F.col("bits") + e_bit, {c: F.col(c) - v for c, v in spared.items()}))
    both = texts.withColumn("least", least).select("part", F.inline(split)).filter("n > 0")
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the cells of masks().

    kept, removed, redundant (fail it, removed earlier), unique_fails (fail nothing else), good_lost, toxic_lost, and
    shapley: what the step's filter removes, over all orders.
    """
    steps = [(order, k, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for order in ORDERS for k in range(len(FILTERS))]
    schema = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    table = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k + 1},"bit":{b},"before":{p}}}' for o, k, b, p in steps) + "]"), schema)
    rows = cells.select("*", F.inline(table))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    of = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0))
    counted = rows.groupBy("part", "filter_order", "step", "bit").agg(
        of(~fails & ~gone).alias("kept"), of(fails & ~gone).alias("removed"), of(fails & gone).alias("redundant"), of(F.col("mask") == F.col("bit")).alias("unique_fails"),
        of(fails & ~gone, "good").alias("good_lost"), of(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows
    return counted.withColumn("shapley", shapley).select("part", "filter_order", "step", *_COUNTS)


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang", **limits) -> DataFrame:
    """audit() of docs (doc_id, text, and the part's column) with labels (doc_id, quality, toxic)."""
    return audit(masks(docs, labels, part, **limits))
