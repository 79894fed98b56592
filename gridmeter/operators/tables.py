"""Publication tables and small inventories over the other operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B

# Why a rule has no score.
REASONS = {"L3-02": "not implemented", "L3-03": "not implemented", "L3-08": "not implemented", "L3-07": "needs several files"}


def clamped_truth(tables: DataFrame, sheets: DataFrame) -> DataFrame:
    """By document: boxes made 1-based and cut to their sheets: n_boxes, n_adjusted, n_dropped, n_missing_sheets. sheets: doc, sheet, max_row, max_col."""
    rows = tables.join(sheets, ["doc", "sheet"], "left").withColumn("b", B.one_based(B.box()))
    rows = rows.withColumn("c", F.when(F.col("max_row").isNotNull(), B.clamped(F.col("b"), F.col("max_row"), F.col("max_col"))))
    known = F.col("max_row").isNotNull()
    moved = F.col("c").isNotNull() & ~((F.col("c.first_row") == F.col("b.first_row")) & (F.col("c.first_col") == F.col("b.first_col")) & (F.col("c.last_row") == F.col("b.last_row")) & (F.col("c.last_col") == F.col("b.last_col")))
    return rows.groupBy("doc").agg(
        F.count("*").alias("n_boxes"), F.count_if(moved).alias("n_adjusted"), F.count_if(known & F.col("c").isNull()).alias("n_dropped"), F.countDistinct(F.when(~known, F.col("sheet"))).alias("n_missing_sheets")
    )


def strata_table(levels: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """By group of files: n, median tables, mean score and percent of zero scores. levels: file, score; files: file, n_tables, group."""
    return files.join(levels, "file").groupBy(group).agg(
        F.countDistinct("file").alias("n"), F.median("n_tables").alias("median_tables"), F.avg("score").alias("mean_score"), (F.try_divide(F.count_if(F.col("score") == 0), F.count("score")) * 100).alias("zero_percent")
    )


def occupancy(cells: DataFrame) -> DataFrame:
    """By document: sheets and cells with a value; empty where it has none."""
    found = cells.groupBy("doc").agg(F.countDistinct("sheet").alias("n_sheets"), F.count_if(F.col("value").isNotNull() & (F.trim("value") != "")).alias("n_cells"))
    return found.withColumn("status", F.when(F.col("n_cells") == 0, "empty").otherwise("ok"))


def sheet_differences(annotated: DataFrame, source: DataFrame) -> DataFrame:
    """Annotated sheets (doc, sheet) that the source doesn't have."""
    return annotated.select("doc", "sheet").distinct().join(source.select("doc", "sheet"), ["doc", "sheet"], "left_anti")


def sheet_order(rows: DataFrame) -> DataFrame:
    """doc, sheet, sheet_index: sheets in the order in which a document's rows (ord) first name them."""
    first = rows.groupBy("doc", "sheet").agg(F.min("ord").alias("first"))
    return first.select("doc", "sheet", (F.row_number().over(Window.partitionBy("doc").orderBy("first", "sheet")) - 1).alias("sheet_index"))


def flip_matrix(rates: DataFrame, families: list[str], digits: int = 1) -> DataFrame:
    """rule_id and a column of flip rates for each family of variants."""
    return rates.groupBy("rule_id").pivot("family", families).agg(F.round(F.first("flip_rate"), digits))


def rule_table(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """Rules in order with their labels: every rule stays."""
    return rules.join(F.broadcast(labels), "rule_id", "left").orderBy("ord")  # a label for each rule


def corrected_rates(rates: DataFrame, moved: DataFrame) -> DataFrame:
    """rule_id, n_applicable, pass_rate, n_moved, reason (where no file is applicable)."""
    reason = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    out = moved.select("rule_id", "n_moved").join(rates, "rule_id", "left").fillna(0, ["n_applicable"])
    return out.select("rule_id", "n_applicable", "pass_rate", "n_moved", F.when(F.col("n_applicable") == 0, F.coalesce(reason[F.col("rule_id")], F.lit("no file"))).alias("reason"))


def fetch_summary(log: DataFrame) -> DataFrame:
    """One row: counts of a fetch log's statuses and the sum of datasets over those that are ok."""
    return log.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "incomplete", "error")), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("n_datasets"))), F.lit(0)).alias("n_datasets"))


def error_records(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status") == "error")


def document(df: DataFrame) -> str:
    """A small result as an indented JSON list."""
    return json.dumps([json.loads(r) for r in df.toJSON().collect()], ensure_ascii=False, indent=2)


def pass_rate_sql(states: DataFrame, rules: DataFrame) -> DataFrame:
    """The pass rates in plain SQL: applicable files, left-joined to the rules, with a rounded percentage."""
    return states.sparkSession.sql(
        """WITH counts AS (SELECT rule_id, count(*) FILTER (WHERE file_state = 'pass') AS n_pass, count(*) FILTER (WHERE file_state IN ('pass', 'fail')) AS n_applicable FROM {states} GROUP BY rule_id)
        SELECT c.rule_id, r.level, c.n_pass, c.n_applicable, round(100.0D * c.n_pass / nullif(c.n_applicable, 0), 2) AS pass_percent FROM counts c LEFT JOIN {rules} r ON r.rule_id = c.rule_id ORDER BY r.level, c.rule_id""",
        states=states, rules=rules,
    )
