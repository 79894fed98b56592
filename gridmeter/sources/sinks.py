"""Writers that never overwrite, and the forms that nested columns take in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)]
    return df.withColumns({c: F.to_json(c) for c in nested})


def write_once(df: DataFrame, path: str, kind: str = "parquet", columns: list[str] | None = None) -> bool:
    """Writes the columns of df to path; False, and nothing written, if path exists."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    out = df.select(*columns) if columns else df
    writer = (csv_ready(out) if kind == "csv" else out).write.mode("errorifexists")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
    return True


def upsert(manifest: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """manifest with columns set from new where it has the key; other rows are untouched."""
    side = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return manifest.join(side, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))
