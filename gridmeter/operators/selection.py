"""Exact order statistics of groups of any size, with a state that is bounded by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import small, written

BINS = 1024


def order_statistics(counted: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """ranks (keys, rank) with value: the rank-th (from 0) of the values of its group.

    counted: keys, value (a double), n. A round cuts each open interval of values into bins and keeps, for each rank, the bin
    that holds it, with the bin's own least and largest value; a rank is settled when both are the same. Rounds cut by
    value and by magnitude in turn, so that two or three do, and a dozen where values differ by hundreds of orders.
    """
    turn = 0
    ends = counted.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = written(joined(ranks, ends, keys).withColumn("skip", F.lit(0).cast("long")))
    while True:
        still = state.filter("lo < hi").select(*keys, "lo", "hi").distinct()
        if not still.count():
            return state.select(*keys, "rank", F.col("lo").alias("value"))
        scale = _magnitude if turn % 2 else lambda c: F.col(c) / 2  # halves, as a difference may overflow
        share, turn = (scale("value") - scale("lo")) / F.nullif(scale("hi") - scale("lo"), F.lit(0.0)), turn + 1
        bin_ = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))
        held = joined(counted, still, keys).filter("value BETWEEN lo AND hi").withColumn("bin", bin_)
        bins = held.groupBy(*keys, "lo", "hi", "bin").agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        before = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        bins = written(bins.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "n", "least", "most", "before"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("lo") == F.col("_lo"), F.col("hi") == F.col("_hi")]
        place = F.col("rank") - F.col("skip")
        met = state.join(small(bins), [*same, place >= F.col("before"), place < F.col("before") + F.col("n")], "left")
        met = met.select(*keys, "rank", F.coalesce("least", "lo").alias("lo"), F.coalesce("most", "hi").alias("hi"), (F.col("skip") + F.coalesce("before", F.lit(0))).alias("skip"))
        state = written(met)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with place, from 0, in their group by order, however large the group: ranges of the order are numbered each, and shifted by the ranges before."""
    spark = rows.sparkSession
    number = F.monotonically_increasing_id()
    keys = [*group, *order]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumns({"_range": F.shiftright(number, 33), "_at": number}))
    ranges = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = written(ranges.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))))
    side = ranges.select(*(F.col(k).alias(f"_{k}") for k in group), F.col("_range").alias("_r"), "_first", "_before")
    met = dealt.join(small(side), [F.col("_range") == F.col("_r"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in group)])
    return met.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("place"))


def _magnitude(c: str) -> Column:
    """Grows with a double, by the same amount for each doubling; zero lies between the smallest ones."""
    return F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log2(F.abs(c)) + 1100))


def joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of other, a few rows for each group, whose keys may be null."""
    if not keys:
        return df.crossJoin(small(other))  # one group: a row for each open interval, at most two for each quantile
    side = other.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    return df.join(small(side), [df[k].eqNullSafe(side[f"_{k}"]) for k in keys]).drop(*(f"_{k}" for k in keys))


def quantiles(counted: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share: linear between the two nearest order statistics of the group."""
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("size"))
    at: dict[str, Column] = {name: (F.col("size") - 1) * F.lit(q) for name, q in shares.items()}
    ends = {name: (F.floor(h), F.least(F.floor(h) + 1, F.col("size") - 1)) for name, h in at.items()}
    sizes = written(sizes)
    ranks = sizes.select(*keys, F.explode(F.array_distinct(F.array(*(r for pair in ends.values() for r in pair)))).alias("rank"))
    found = order_statistics(counted, keys, ranks)
    of = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"))  # two for each share
    value = lambda name: F.col("of")[ends[name][0]] + (F.col("of")[ends[name][1]] - F.col("of")[ends[name][0]]) * (at[name] - ends[name][0])
    return joined(sizes, of, keys).select(*keys, *(value(name).alias(name) for name in shares))
