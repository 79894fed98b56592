"""Nested check evidence to a tri-state matrix of files and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules without an implementation, rules that only a run over many files decides, and
# messages by which a check says that it didn't apply.
NOT_IMPLEMENTED = ("L3-02", "L3-03", "L3-08")
BULK_ONLY = ("L3-07",)
SKIP_MESSAGES = "スキップ|判定対象外|チェック対象外|判定でき|検出されなかったため|特定でき|情報がない|情報不足|報告済み|地域データ列が検出されませんでした"


def branch(rule_id: Column, passed: Column, not_applicable: Column, confidence: Column, message: Column, has_violations: Column) -> Column:
    """How a check was executed."""
    skipped = F.coalesce(not_applicable, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) == 0) | F.coalesce(message, F.lit("")).rlike(f"(?i)(?:{SKIP_MESSAGES})")
    return (
        F.when(rule_id.isin(*NOT_IMPLEMENTED), "not_implemented")
        .when(rule_id.isin(*BULK_ONLY), "bulk_only")
        .when(skipped, "semantic_skip")
        .when(F.coalesce(has_violations, F.lit(False)), "violation_checked")
        .when(passed, "no_candidate")
        .otherwise("violation_checked")
    )


def tri_state(branch_: Column, passed: Column) -> Column:
    return F.when(branch_.isin("not_implemented", "bulk_only", "semantic_skip"), "abstain").when(passed, "pass").otherwise("fail")


def audit_status(branch_: Column) -> Column:
    return F.when(branch_ == "no_candidate", "needs_intermediate_metric").otherwise("mapped")


def classified(checks: DataFrame) -> DataFrame:
    """checks with branch, tri_state and audit_status."""
    has = F.col("n_violations") > 0
    found = checks.withColumn("branch", branch(F.col("rule_id"), F.col("passed"), F.lit(False), F.col("confidence"), F.lit(""), has))
    return found.withColumns({"tri_state": tri_state(F.col("branch"), F.col("passed")), "audit_status": audit_status(F.col("branch"))})


def flatten_checks(documents: DataFrame) -> DataFrame:
    """One row for each check of each area of each sheet of documents (stem, sheets array of name, areas array of range, checks), with ordinals from 1."""
    sheets = documents.select("stem", F.posexplode("sheets").alias("s", "sheet"))
    areas = sheets.select("stem", (F.col("s") + 1).alias("sheet_no"), "sheet.name", F.posexplode("sheet.areas").alias("a", "area"))
    checks = areas.select("stem", "sheet_no", F.col("name").alias("sheet_name"), (F.col("a") + 1).alias("area_no"), "area.range", F.posexplode("area.checks").alias("c", "check"))
    return checks.select("stem", "sheet_no", "sheet_name", "area_no", "range", (F.col("c") + 1).alias("check_no"), "check.*")


def flatten_violations(checks: DataFrame) -> DataFrame:
    """One row for each violation of flatten_checks' rows, in order."""
    return checks.select("stem", "rule_id", "sheet_name", F.posexplode("violations").alias("v", "violation")).select("stem", "rule_id", "sheet_name", (F.col("v") + 1).alias("violation_no"), "violation.*")


VIOLATION_KEY = ["stem", "rule_id", "sheet_name", "cell_range", "description"]


def unique_violations(violations: DataFrame) -> DataFrame:
    """One row for each natural key, with the severity of the first arrival (ord)."""
    return violations.groupBy(*VIOLATION_KEY).agg(F.min_by("severity", "ord").alias("severity"))


def violation_counts(violations: DataFrame) -> DataFrame:
    return unique_violations(violations).groupBy("stem", "rule_id").agg(F.count("*").alias("n_unique_violations"))


def file_state(n_fail: Column, n_pass: Column, n_abstain: Column) -> Column:
    return F.when(n_fail > 0, "fail").when(n_pass > 0, "pass").when(n_abstain > 0, "abstain").otherwise("no_table")


def file_rule_states(items: DataFrame, rows: DataFrame, file_checks: DataFrame) -> DataFrame:
    """The dense grid of items (stem) and all rules, with counts of table states and the file's own verdict where it has one.

    rows: stem, rule_id, tri_state; file_checks: stem, rule_id, passed, skipped. The set of rules is small.
    """
    count = lambda s: F.count_if(F.col("tri_state") == s).alias(f"n_{s}")
    counts = rows.groupBy("stem", "rule_id").agg(F.count("*").alias("n_tables"), count("pass"), count("fail"), count("abstain"))
    rules = rows.select("rule_id").union(file_checks.select("rule_id")).distinct()
    grid = items.select("stem").crossJoin(F.broadcast(rules))
    own = file_checks.select("stem", "rule_id", F.col("passed").alias("file_passed"), F.col("skipped").alias("file_skipped"))
    out = grid.join(counts, ["stem", "rule_id"], "left").join(own, ["stem", "rule_id"], "left").fillna(0, ["n_tables", "n_pass", "n_fail", "n_abstain"])
    return out.withColumn("file_state", file_state(F.col("n_fail"), F.col("n_pass"), F.col("n_abstain")))


def candidate_wide(files: DataFrame, rules: list[str]) -> DataFrame:
    """A column rule_<id> of verdicts for each rule, and the failed and skipped rules joined by semicolons."""
    verdict = F.when(F.col("skipped"), "skip").when(F.col("passed"), "pass").otherwise("fail")
    wide = files.groupBy("stem").pivot("rule_id", rules).agg(F.first(verdict))
    wide = wide.select("stem", *(F.col(r).alias(f"rule_{r}") for r in rules))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("rule_id")))), ";")
    lists = files.groupBy("stem").agg(joined(~F.col("skipped") & ~F.col("passed")).alias("failed_rules"), joined(F.col("skipped")).alias("skipped_rules"))
    return wide.join(lists, "stem")


def reconciliation(states: DataFrame) -> DataFrame:
    """By rule: files that the file verdict counts, files that the table states count, and those that moved to abstain."""
    used = F.col("file_skipped") == F.lit(False)
    return states.groupBy("rule_id").agg(
        F.count_if(used).alias("n_original"), F.count_if(F.col("file_state").isin("pass", "fail")).alias("n_corrected"),
        F.count_if(used & (F.col("file_state") == "abstain")).alias("n_moved"), F.count_if(used & F.col("file_passed")).alias("pass_original"), F.count_if(F.col("file_state") == "pass").alias("pass_corrected"),
    )


def state_rates(states: DataFrame, weights: DataFrame, group: str) -> DataFrame:
    """Pass rates of file states by a file attribute, weighted by file; files without a weight row drop out. weights: stem, group, weight."""
    rows = states.filter(F.col("file_state").isin("pass", "fail")).join(weights, "stem")
    ok = F.col("file_state") == "pass"
    sums = rows.groupBy(group, "rule_id").agg(F.count("*").alias("n_applicable"), F.count_if(ok).alias("n_pass"), F.sum("weight").alias("w_applicable"), F.sum(F.when(ok, F.col("weight")).otherwise(0)).alias("w_pass"))
    return sums.withColumns({"pass_rate": F.try_divide("n_pass", "n_applicable"), "weighted_pass_rate": F.try_divide("w_pass", "w_applicable")})
