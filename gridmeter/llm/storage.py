"""Shared working folders, and cutting lineage through written tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import numbered as numbered_in_order


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (or the context's checkpoint folder), which all executors share.

    Only where neither is set and the master is local (tests, a single machine) is a local folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_one = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_one.get() if set_one.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridmeter-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/gridmeter-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_gridmeter_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="gridmeter-code-")) / "gridmeter.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(target))
    context._gridmeter_shipped = True


@contextlib.contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here are planned before they run and not again after each shuffle.

    For steps whose partitions are stated or even, and whose joins are broadcast or even: they gain nothing from another plan, while each
    shuffle's own job, thread, plan and description stay in the driver for a while.
    """
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def materialize(df: DataFrame, by: str | None = None, adaptive: bool = True) -> DataFrame:
    """df, written once to the shared folder as Parquet and read again: a cut in the lineage that outlives executors.

    by: a column that gets a folder for each of its values, so that filters on it read no others. adaptive: see planned_once.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    schema = df.schema
    writer = df.write.partitionBy(by) if by else df.write
    with contextlib.nullcontext() if adaptive else planned_once(spark):
        writer.parquet(path)
    out = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    out.folders = [path]
    return out


def release(df: DataFrame, part: str = "") -> None:
    """Deletes the folders of a materialized table, or one part of them, that nothing will read again."""
    spark = df.sparkSession
    for folder in getattr(df, "folders", []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}" if part else folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame) -> DataFrame:
    """df, written once, with row, a long that tells equal rows apart."""
    return materialize(df.withColumn("row", F.monotonically_increasing_id()))


def with_keys(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with key, a long in the order of doc_id that tells rows of one doc_id apart where their texts differ.

    It is doc_id itself where none repeats. Else each pair of doc_id and text gets its place among all, in the order of doc_id and the text's
    SHA-256; rows that repeat both share it. Null where doc_id is.
    """
    named = docs.filter("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    places = numbered_in_order(named.select(F.col("doc_id").alias("_id"), digest.alias("_digest")).distinct(), [], ["_id", "_digest"])
    marked = docs.withColumn("_own", digest)
    return marked.join(places.withColumnRenamed("place", "key"), [F.col("doc_id") == F.col("_id"), F.col("_own") == F.col("_digest")], "left").select(*docs.columns, "key")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Arrow batches of so many rows and bytes at most: their buffers, in Java and in Python, otherwise hold 10,000 rows or 64 MB. Parquet's batches likewise: 4096 rows of texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


#: A side of at most so many rows of a few longs (some 16 MB) may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000
