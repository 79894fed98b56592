"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the schedule has the point frac((i + 1) * golden ratio); the sources' cumulative numbers of blocks
map it to a source. A slot's rank within its source picks that source's next block of equally many words:
its documents, shuffled by the MD5 of their ids and texts, stand end to end, and the stream starts over when it ends.
So every prefix of the schedule is mixed close to the target weights. A rank beyond a source's last block is
skipped; the few ranks that the points missed follow at the end, by source and rank. Thus each source gives
exactly its target, and a document's first slot says where in the mix it stands.

No step collects sources or documents: ranks and positions come from sums over fixed chunks and within
them, so one source may hold most rows.

Defined results: a null text has size 0 and is taken 0 times; the null source is a source, the last one;
equal rows keep their own shares; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, materialize, numbered, partitions

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: Words of a block, leading digits of a hash that make a chunk of a source's stream, slots of a chunk of the schedule.
BLOCK_WORDS = 1024
DIGITS = 3
SLOT_CHUNK = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, keys: list[str], order: list[str], value: Column) -> Column:
    """The sum of value over the rows of the same keys that come before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of every source of sizes (source, size), and p, the range of sources it is in.

    Sources by code point, null last, weigh as weights repeats; they share `share` times all words, a
    target stops at `most` times its source's size, and the excess is shared again by weight.
    """
    known, order = _ordered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)))
    split = _before(known, order, "one")
    rank = F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = materialize(split.select("p", "source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight; the sources with more than their most at this level are full
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        held, open_weight = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        new = (share * total - (held or 0.0)) / open_weight
        if new <= level:
            break
        level = new
    return ranked.select("p", "source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _ordered(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df (source, ...) in ranges p of sources, and the order of sources within one."""
    order = [F.col("source").isNull(), F.col("source")]
    return materialize(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("p", F.spark_partition_id())), order


def _before(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """df (p, source, value, ...) with before: the sum of value over all earlier sources."""
    sums = df.groupBy("p").agg(F.sum(value).alias("s"))  # a row for each partition
    sums = sums.select("p", _running(sums, [], ["p"], F.col("s")).alias("earlier"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(sums, "p").withColumn("before", own + F.col("earlier")).drop("earlier")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, rank, words: the slots in order, the block of its source each takes, and that block's words. targets: p, source, target."""
    spark = targets.sparkSession
    goals = targets.select("p", "source", F.floor("target").cast("long").alias("goal")).filter("goal > 0")
    order = [F.col("source").isNull(), F.col("source")]
    cuts = materialize(_before(goals.withColumn("quota", F.ceil(F.col("goal") / block_words).cast("long")), order, "quota").withColumnRenamed("before", "low"))
    n, sources = cuts.agg(F.sum("quota"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "slot long, source string, rank long, words long")
    cells = sources  # as many as sources: a cell meets two of them on average, however unequal they are
    cell = lambda c: F.least(F.floor(c * cells / n), F.lit(cells - 1)).cast("long")
    spans = cuts.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("low") + F.col("quota")))))
    point = F.expr(f"(id + 1) * {GOLDEN}D")
    slots = spark.range(n).withColumn("y", (point - F.floor(point)) * F.lit(float(n))).withColumn("cell", cell(F.col("y")))
    inside = (F.col("y") >= F.col("low")) & (F.col("y") < F.col("low") + F.col("quota"))
    few = sources <= BROADCAST_ROWS // 4  # a source has two or three spans on average
    slots = slots.join(F.broadcast(spans) if few else spans, "cell").filter(inside).select("id", "source", "goal", "quota", F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"))
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("source", "chunk", _running(counts, ["source"], ["chunk"], F.col("n")).alias("before"))
    s, c = slots.alias("s"), counts.alias("c")
    within = F.row_number().over(Window.partitionBy("s.source", "s.chunk").orderBy("id")) - 1
    ranked = s.join(c, F.expr("s.source <=> c.source AND s.chunk = c.chunk")).select("id", "s.source", "goal", "quota", (within + F.col("before")).alias("rank")).filter("rank < quota")
    ranked = materialize(ranked, adaptive=not few)  # chunks are even, and cells meet no shuffle
    had = ranked.groupBy("source").agg(F.count("*").alias("had"))
    both = cuts.select("p", "source", "goal", "quota").alias("t").join(had.alias("h"), F.expr("t.source <=> h.source"), "left")
    missed = both.select("p", "t.source", "goal", "quota", (F.col("quota") - F.coalesce("had", F.lit(0))).alias("missed"))
    missed = _before(missed, order, "missed").filter("missed > 0")
    rank = F.explode(F.sequence(F.col("quota") - F.col("missed"), F.col("quota") - 1)).alias("rank")
    missed = missed.select("source", "goal", "quota", "missed", "before", rank)
    missed = missed.select((F.lit(n) + F.col("before") + F.col("rank") - (F.col("quota") - F.col("missed"))).alias("id"), "source", "goal", "quota", "rank")
    slots = ranked.unionByName(missed)
    return slots.select(F.col("id").alias("slot"), "source", "rank", F.least(F.lit(block_words), F.col("goal") - F.col("rank") * block_words).alias("words"))


def stream(sizes: DataFrame) -> DataFrame:
    """sizes (doc_id, source, size, place, row) with at: where the row stands in its source's shuffled stream of words."""
    sizes = sizes.withColumn("chunk", F.substring("place", 1, DIGITS))
    sums = sizes.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    sums = sums.select("source", "chunk", _running(sums, ["source"], ["chunk"], F.col("n")).alias("before"))
    joined = sizes.alias("d").join(sums.alias("s"), F.expr("d.source <=> s.source AND d.chunk = s.chunk")).select("d.*", "before")
    return joined.withColumn("at", F.col("before") + _running(joined, ["source", "chunk"], ["place", "row"], F.col("size"))).drop("before", "place", "chunk")


def mix(sizes: DataFrame, targets: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, row, doc_id, from_word, words: what each slot takes of which document. sizes: doc_id, source, size, place, row."""
    placed = stream(sizes.filter("size > 0")).alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "source_size", "target")
    passes = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)))
    passed = placed.withColumn("pass", passes).withColumn("low", F.col("pass") * F.col("source_size") + F.col("at"))
    first, last = F.floor(F.col("low") / block_words), F.floor((F.col("low") + F.col("size") - 1) / block_words)
    pieces = passed.withColumn("rank", F.explode(F.sequence(first, last)))
    p, s = pieces.alias("p"), slots.alias("s")
    both = p.join(s, F.expr("p.source <=> s.source AND p.rank = s.rank"))
    start = F.greatest("low", F.col("p.rank") * block_words)
    end = F.least(F.col("low") + F.col("size"), F.col("p.rank") * block_words + F.col("words"))
    return both.select("slot", "row", "doc_id", (start - F.col("low")).alias("from_word"), (end - start).alias("words")).filter("words > 0")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size and place (in the shuffle of its source) of docs (doc_id, source, text), and more columns."""
    words = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("text"))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(words.cast("binary")).alias("place"), *more)


def shares(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, row, source_size, target, taken, first_slot, last_slot of every row of sizes (doc_id, source, size, place, row)."""
    targets = source_targets(sizes)
    slots = schedule(targets, block_words)
    few = targets.count() <= BROADCAST_ROWS
    met = mix(sizes, F.broadcast(targets) if few else targets, slots, block_words)  # the other joins are by even chunks and blocks of the sources
    got = materialize(met.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")), adaptive=not few)
    out = sizes.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "source_size", "target").join(got, "row", "left")
    return out.select("doc_id", "source", "size", "row", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot (null: not taken) of every row of docs (doc_id, source, text)."""
    return shares(numbered(sized(docs)), block_words).drop("row", "last_slot")
