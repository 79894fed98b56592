"""Guards: key uniqueness, one-to-one joins, domains, required fields, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_problems(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, problem of every key that keeps a join from being one to one: blank, duplicate, missing (not right) or extra (not left)."""
    l, r = (d.groupBy(key).agg(F.count("*").alias("n")) for d in (left, right))
    blank = lambda d: d.filter(F.col(key).isNull() | (F.col(key).cast("string") == "")).select(key, F.lit("blank").alias("problem"))
    twice = lambda d: d.filter("n > 1").select(key, F.lit("duplicate").alias("problem"))
    missing, extra = l.join(r, key, "left_anti").select(key, F.lit("missing").alias("problem")), r.join(l, key, "left_anti").select(key, F.lit("extra").alias("problem"))
    return reduce(DataFrame.unionByName, [blank(l), blank(r), twice(l), twice(r), missing, extra])


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, which fails as it runs where the condition isn't true."""
    ok = F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull()
    return df.filter(ok)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def prefix_mismatches(df: DataFrame, full: str, short: str) -> DataFrame:
    """Rows whose full digest doesn't start with the short one; an empty one isn't compared."""
    return df.filter((F.coalesce(short, F.lit("")) != "") & ~F.startswith(F.col(full), F.col(short)))


def unknown_values(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*domain)).groupBy(column).agg(F.count("*").alias("n"))


def missing_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n_missing of each column."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing")) for c in columns))))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def file_digests(files: DataFrame) -> DataFrame:
    """path, length, md5, sha256, short of binaryFile rows."""
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.substring(F.sha2("content", 256), 1, 16).alias("short"))
