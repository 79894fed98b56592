"""A training corpus from documents: toxicity, near duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

Stages work on rows: a row is told from others by a number of its own, never by its doc_id. Defined results: an
empty table passes every stage; documents without doc_id are scored and kept, take no part in near-duplicate
groups, and are mixed like any others; documents without words are clean, stay through the filters, and the
mix takes none of them, as it takes words; rows that repeat a doc_id are copies where their texts are near
ones, and documents of their own where they are not. The mix's rows come in the order of its slots, which the shards' rows carry as `slot`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmeter.llm import decontamination, mixing, ngram_join, sharding
from gridmeter.llm import toxicity as classifier
from gridmeter.llm.storage import BROADCAST_ROWS, materialize, numbered, partitions, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.5."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.with_scores(docs.select(*COLUMNS), model).filter("score < 0.5").drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that 80 % of their five-word shingles link, the one with the least doc_id."""
    rows = numbered(docs.select(*COLUMNS))
    known = rows.filter("doc_id IS NOT NULL")
    found = materialize(ngram_join.linked(known.select(F.col("row").alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias("row"), "component_id"))
    several = found.filter("row <> component_id").select("component_id").distinct()
    members = found.join(several, "component_id").join(known.select("row", "doc_id"), "row")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    lost = materialize(members.join(first, "component_id").filter("row <> first.row").select("row"))
    return rows.join(_small(lost), "row", "left_anti").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bad = materialize(decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    return docs.select(*COLUMNS).alias("d").join(_small(bad).alias("b"), F.expr("d.doc_id <=> b.doc_id"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, to the nearest whole time (not at all, once or twice), where its first and last slot have it."""
    rows = numbered(docs.select(*COLUMNS))
    mix = mixing.shares(materialize(mixing.sized(rows, "row")))
    times = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    places = mix.select("row", F.slice(F.array("first_slot", "last_slot"), 1, times).alias("slots")).filter(F.size("slots") > 0)
    places = materialize(places.select("row", F.explode("slots").alias("slot")))
    both = rows.join(_small(places), "row").repartitionByRange(partitions(spark), "slot", "row").sortWithinPartitions("slot", "row")
    return both.select(*COLUMNS)


def _in_place(docs: DataFrame) -> DataFrame:
    """docs with slot, from 0: the order of rows in the files of the table that docs is read from, which is the mix's; nothing but a count for each file is moved.

    Of docs that are no table's (made in the session) slot is the order of their partitions and rows, with gaps.
    """
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        placed.schema  # noqa: B018 - resolves the names
    except AnalysisException:
        return docs.select(*COLUMNS, F.monotonically_increasing_id().alias("slot"))
    part = F.expr("CAST(regexp_extract(_file, 'part-([0-9]+)', 1) AS LONG)")
    counts = placed.groupBy("_file").agg(F.count("*").alias("n"))
    ahead = Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = materialize(counts.select("_file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")))
    return placed.join(_small(before), "_file").select(*COLUMNS, (F.col("before") + F.col("_at")).alias("slot"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the committed version of a compacted store holds them, with the slots that the mix has them at, and their shards."""
    return sharding.placed(sharding.shard(_in_place(docs), shared_folder(spark))).select(*COLUMNS, "slot", "shard", "tier")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("source_mixing", source_mix),
    ("sharding", shards),
]

#: A trained classifier is no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
