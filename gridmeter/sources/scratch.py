"""Written tables that cut a lineage, in the folder that the session names for all executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows of a few numbers may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: Rows of a partition where a step deals rows out by their count.
ROWS_OF_PART = 100_000
#: Up to so many partitions a shuffle's rows go straight to their files (spark.shuffle.sort.bypassMergeThreshold); with more, a map task holds and sorts all it has read.
DIRECT_PARTS = 200
#: Rows of a partition from which on there are more than DIRECT_PARTS, as a multiple of ROWS_OF_PART.
MOST_TIMES = 15


def new_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridmeter-")
    return f"{base.rstrip('/')}/gridmeter-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_gridmeter_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="gridmeter-code-")) / "gridmeter.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(target))
    context._gridmeter_sent = True


def written(df: DataFrame) -> DataFrame:
    """df, written once and read again: what follows survives lost executors without computing df anew."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def parts(*tables: DataFrame) -> int:
    """How many partitions the tables' rows fill together. They are stored, so that their counts are in their files' footers."""
    rows = sum(df.count() for df in tables)
    of = lambda size: -(-rows // size)
    return max(1, min(of(ROWS_OF_PART), max(DIRECT_PARTS, of(MOST_TIMES * ROWS_OF_PART))))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df by keys in n partitions, so that a task's sorts and maps hold the same whether there are few or many rows. What follows by these keys stays in them."""
    return df.repartition(n, *keys)
