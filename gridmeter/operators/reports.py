"""Cross-tabulations and tables that reports print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heatmap(stats: DataFrame, group: str, groups: list[str], min_n: int = 10) -> DataFrame:
    """rule_id and a column for each group: its pass rate, null below min_n files."""
    cell = F.first(F.when(F.col("n_applicable") >= min_n, F.col("pass_rate")))
    return stats.groupBy("rule_id").pivot(group, groups).agg(cell)


def extension_crosstab(files: DataFrame, key: str) -> DataFrame:
    """key, total, xls, xlsx, ratio (of xls, in percent), highest first."""
    out = files.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("ext") == ".xls").alias("xls"), F.count_if(F.col("ext") == ".xlsx").alias("xlsx"))
    return out.withColumn("ratio", F.round(F.try_divide(100 * F.col("xls"), F.col("total")), 1)).orderBy(F.desc("ratio"), key)


def year_buckets(files: DataFrame, size: int = 5) -> DataFrame:
    """Counts by bucket of years; unknown years last."""
    low = F.floor(F.col("year") / size) * size
    label = F.when(F.col("year").isNull(), "unknown").otherwise(F.concat_ws("-", low.cast("string"), (low + size - 1).cast("string")))
    return extension_crosstab(files.withColumn("bucket", label), "bucket").orderBy(F.col("bucket") == "unknown", "bucket")


def top(files: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n keys with the most xls files: a report's list."""
    return extension_crosstab(files, key).orderBy(F.desc("xls"), key).limit(n)


def status_counts(log: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """status, n of the known statuses, with zeros, and of any others."""
    known = log.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = log.groupBy("status").agg(F.count("*").alias("n"))
    return known.join(counts, "status", "full").fillna(0, ["n"])


def conversion_status(missing_sheets: Column, empty_ranges: Column, n_cells: Column) -> Column:
    return F.when(n_cells == 0, "empty").when(missing_sheets > 0, "sheet_mismatch").when(empty_ranges > 0, "empty_range").otherwise("ok")


def funnel(cells: DataFrame) -> DataFrame:
    """One row of sums over cells (cell, pool_n, top_share, n_selected): in scope, selected, cells that one survey dominates."""
    return cells.agg(F.sum("pool_n").alias("in_scope"), F.sum("n_selected").alias("selected"), F.count("*").alias("cells"), F.count_if(F.col("top_share") > 0.5).alias("dominated"))


def percent(x: Column, digits: int = 1) -> Column:
    """A share as text; a dash where it is null."""
    return F.when(x.isNull(), "―").otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def typst_escape(x: Column) -> Column:
    """Text for a typesetter: a backslash before each of nine marks, a dash for null."""
    return F.coalesce(F.regexp_replace(x, r"([\\#$*_`<>@])", r"\\$1"), F.lit("―"))


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A small report table as Markdown."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.select(*columns).collect()])
