"""Rule verdicts: table to file, pass rates with intervals, level scores, contrasts between groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import wilson_high, wilson_low

UNCLASSIFIED = "(未分類)"
#: The fewest applicable files of a group that is compared with others.
MIN_CONTRAST = 20


def file_rollup(checks: DataFrame) -> DataFrame:
    """stem, rule_id, passed, confidence, severity, n_violations, skipped: a file passes a rule if all its tables do."""
    return checks.groupBy("stem", "rule_id").agg(
        F.bool_and("passed").alias("passed"),
        F.max("confidence").alias("confidence"),
        F.min_by(F.when(F.col("severity").isNotNull(), F.col("severity")), F.when(F.col("severity").isNotNull(), F.col("ord"))).alias("severity"),
        F.sum("n_violations").alias("n_violations"),
        (F.max("confidence") == 0).alias("skipped"),
    )


def accumulate(files: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates by keys and rule_id. files: stem, rule_id, passed, skipped, n_violations, weight, keys; groups: keys, n_files (all files of the group)."""
    used = ~F.col("skipped")
    sums = files.groupBy(*keys, "rule_id").agg(
        F.count_if(used).alias("n_applicable"),
        F.count_if(used & F.col("passed")).alias("n_pass"),
        F.sum("n_violations").alias("n_violations"),
        F.coalesce(F.sum(F.when(used, F.col("weight"))), F.lit(0)).alias("w_applicable"),
        F.coalesce(F.sum(F.when(used & F.col("passed"), F.col("weight"))), F.lit(0)).alias("w_pass"),
    )
    joined = sums.join(groups, keys) if keys else sums.crossJoin(F.broadcast(groups))  # one row
    return joined.withColumns({
        "pass_rate": F.try_divide("n_pass", "n_applicable"),
        "applicability_rate": F.try_divide("n_applicable", "n_files"),
        "weighted_pass_rate": F.try_divide("w_pass", "w_applicable"),
    })


def with_interval(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"ci_low": wilson_low(F.col("n_pass"), F.col("n_applicable")), "ci_high": wilson_high(F.col("n_pass"), F.col("n_applicable"))})


def strata(files: DataFrame, dimensions: list[str]) -> DataFrame:
    """A row for each file and dimension: dimension, value."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit(UNCLASSIFIED)).alias("value")) for d in dimensions))
    return files.select("*", F.inline(pairs))


def stats_by_stratum(files: DataFrame, dimensions: list[str]) -> DataFrame:
    rows = strata(files, dimensions)
    sizes = rows.groupBy("dimension", "value").agg(F.countDistinct("stem").alias("n_files"))
    return accumulate(rows, sizes, ["dimension", "value"])


def stats_grouping_sets(files: DataFrame, dimensions: list[str]) -> DataFrame:
    """Overall and by each dimension in one pass of grouping sets: rule_id, the dimensions (null where summed over), n_applicable, n_pass."""
    sets = [["rule_id"], *(["rule_id", d] for d in dimensions)]
    grouped = files.groupingSets([[F.col(c) for c in s] for s in sets], F.col("rule_id"), *map(F.col, dimensions))
    level = reduce(lambda a, b: a + b, (F.grouping(d) * (1 << i) for i, d in enumerate(dimensions)))
    return grouped.agg(level.cast("int").alias("summed_over"), F.count_if(~F.col("skipped")).alias("n_applicable"), F.count_if(~F.col("skipped") & F.col("passed")).alias("n_pass"))


def level_stats(levels: DataFrame) -> DataFrame:
    """level, n, mean, median, min, max, n_zero, n_forced_zero; forced zeros count even where the score is null."""
    return levels.groupBy("level").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.count_if(F.col("score") == 0).alias("n_zero"), F.count_if("forced_zero").alias("n_forced_zero"),
    )


def contrasts(stats: DataFrame, group: str, min_n: int = MIN_CONTRAST) -> DataFrame:
    """For each rule its groups with the highest and lowest pass rate, among those with enough files, and the difference."""
    rated = stats.filter((F.col("n_applicable") >= min_n) & F.col("pass_rate").isNotNull()).withColumn("rate", F.round("pass_rate", 4))
    key = F.struct("rate", group)
    ends = rated.groupBy("rule_id").agg(
        F.count("*").alias("n_groups"),
        *(f(F.struct(group, "rate", "n_applicable", "n_pass"), key).alias(a) for f, a in ((F.max_by, "hi"), (F.min_by, "lo"))),
    ).filter("n_groups >= 2")
    flat = [F.col(f"{a}.{c}").alias(f"{p}_{n}") for a, p in (("hi", "max"), ("lo", "min")) for c, n in ((group, "group"), ("rate", "rate"), ("n_applicable", "n"), ("n_pass", "n_pass"))]
    return ends.select("rule_id", "n_groups", *flat, F.round(F.col("hi.rate") - F.col("lo.rate"), 4).alias("diff"))


def bootstrap_intervals(pairs: DataFrame, replicates: int = 2000, seed: int = 20260804) -> DataFrame:
    """rule_id, ci_low, ci_high of contrasts: a parametric bootstrap of the difference, with Python's generator seeded by rule."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib
        from random import Random

        rows = []
        for r in pdf.itertuples():
            rng = Random(seed + int(hashlib.sha256(r.rule_id.encode()).hexdigest()[:8], 16))
            draw = lambda n, k: rng.binomialvariate(int(n), k / n) / n  # noqa: B023, E731
            d = sorted(draw(r.max_n, r.max_n_pass) - draw(r.min_n, r.min_n_pass) for _ in range(replicates))
            at = lambda q: round(d[int(round(q * (replicates - 1)))], 4)  # noqa: B023, E731
            rows.append((r.rule_id, at(0.025), at(0.975)))
        return pd.DataFrame(rows, columns=["rule_id", "ci_low", "ci_high"])

    return pairs.groupBy("rule_id").applyInPandas(one, "rule_id string, ci_low double, ci_high double")


def last_per_key(rows: DataFrame, keys: list[str], order: str, first: bool = False) -> DataFrame:
    """One row for each key: the last by order, or the first."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc() if first else F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
