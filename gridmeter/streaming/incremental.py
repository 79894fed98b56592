"""Check records that arrive as files: only new keys are worked on, rates follow as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.keyed import KeyedTable


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_new(source: DataFrame, target: str, key: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Adds rows whose key the keyed table at target lacks; a batch that comes again adds nothing.

    A batch reads only the buckets of its own keys, not the whole target; KeyedTable(spark, target, [key]).read() has the rows.
    """

    def batch(df: DataFrame, _: int) -> None:
        df.persist()
        KeyedTable(df.sparkSession, target, [key], buckets).add_missing(df)
        df.unpersist()

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def running_rates(source: DataFrame) -> DataFrame:
    """rule_id, n, n_pass, pass_rate of a stream of rule_id, passed, skipped: for complete or update mode."""
    used = source.filter(~F.col("skipped"))
    return used.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_pass")).withColumn("pass_rate", F.try_divide("n_pass", "n"))


def windowed_rates(source: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """The same by windows of time, for append mode; rows later than `late` are dropped by the watermark."""
    used = source.filter(~F.col("skipped")).withWatermark(time, late)
    return used.groupBy(F.window(time, width).alias("window"), "rule_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_pass"))
