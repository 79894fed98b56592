"""Programs end to end: every result of every program, and agreement with the queries over the same tables."""

import os

import pytest
from pyspark.sql import functions as F

from gridmeter import programs
from gridmeter.plans import queries
from gridmeter.plans.standins import view

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df, *columns):
    return sorted(map(str, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in (df.select(*columns) if columns else df).collect())))


def test_score_run(spark, tmp_path):
    checks = view(spark, DATA, "checks")
    manifest = checks.groupBy("stem").agg(*(F.first(c).alias(c) for c in ("gov_org", "stat_type", "weight")))
    got = programs.score_run(checks, manifest, view(spark, DATA, "levels").withColumn("file", F.col("file")))
    assert rows(got["overall"], "rule_id", "n_applicable", "n_pass", "pass_rate", "weighted_pass_rate") == rows(queries.rule_stats_overall(spark, DATA), "rule_id", "n_applicable", "n_pass", "pass_rate", "weighted_pass_rate")
    assert rows(got["by_stratum"], "dimension", "value", "rule_id", "n_files", "n_pass") == rows(queries.rule_stats_by_stratum(spark, DATA), "dimension", "value", "rule_id", "n_files", "n_pass")
    assert rows(got["contrasts"]) == rows(queries.group_contrasts(spark, DATA))
    assert got["levels"].count() and got["contrast_intervals"].count() == got["contrasts"].count()
    few = programs.score_run(checks, manifest, limit=5)
    assert few["overall"].first().n_files == 5 and few["files"].select("stem").distinct().count() <= 5
    assert all(programs.save({"overall": got["overall"], "files": got["files"]}, f"file://{tmp_path}/out").values())
    assert not any(programs.save({"overall": got["overall"]}, f"file://{tmp_path}/out").values())


def test_evaluate(spark):
    roles = view(spark, DATA, "roles").select("conv_id", "ord", "turn", F.col("truth").alias("role"), "guess")
    got = programs.evaluate(view(spark, DATA, "gt"), view(spark, DATA, "pred"), roles, roles.select("conv_id", "turn", "ord", F.col("guess").alias("role")), ("conv_id", "turn"))
    assert rows(got["eob"], "n", "tp", "fp", "fn", "f1") == rows(queries.eob_micro(spark, DATA), "n", "tp", "fp", "fn", "f1")
    assert rows(got["areas"], "gt_area", "pred_area", "inter_area") == rows(queries.coverage_micro(spark, DATA), "gt_area", "pred_area", "inter_area")
    assert rows(got["iou"]) == rows(queries.iou_summary(spark, DATA)) and rows(got["iou_histogram"]) == rows(queries.iou_histogram(spark, DATA))
    assert rows(got["over_split"]) == rows(queries.over_split_files(spark, DATA))
    assert got["confusion"].count() == 3 and got["macro_f1"].first().macro_f1 is not None and got["counts"].first().n_gt == view(spark, DATA, "gt").count()


def test_compare(spark):
    levels = view(spark, DATA, "levels")
    base = levels.select("file", "level", "score", "forced_zero")
    variant = levels.select("file", "level", F.col("variant_score").alias("score"), "forced_zero", F.explode(F.array(F.lit("split_2"), F.lit("detector"))).alias("variant"))
    got = programs.compare(base, variant, view(spark, DATA, "states"), view(spark, DATA, "variant_states"), view(spark, DATA, "families"))
    one = got["level_deltas"].filter("variant = 'split_2'").drop("variant")
    assert rows(one, "level", "n", "n_changed", "mean") == rows(queries.level_deltas(spark, DATA), "level", "n", "n_changed", "mean")
    assert rows(got["transitions"].filter("variant = 'split_2'").drop("variant")) == rows(queries.rule_transitions(spark, DATA))
    assert rows(got["flip_rates"]) == rows(queries.flip_rates(spark, DATA))
    assert {r.variant for r in got["unchanged"].select("variant").distinct().collect()} == {"split_2", "detector"}


def test_dedup_and_samples(spark):
    frame = spark.createDataFrame([("1", "Census", "core")], "gov_stats_code string, gov_stats_name string, stats_type string")
    got = programs.dedup(view(spark, DATA, "resources"), frame)
    assert rows(got["summary"]) == rows(queries.template_summary(spark, DATA)) and rows(got["dropped"]) == rows(queries.resource_filter(spark, DATA))
    assert got["templates"].count() == queries.template_dedup(spark, DATA).count() and {r.gov_stats_name for r in got["templates"].filter("survey = '1'").collect()} <= {"Census"}
    pool = view(spark, DATA, "pool")
    sample = programs.stratified(pool, 7, 3)
    assert sample["selected"].groupBy("cell").count().filter("count > 7").isEmpty() and sample["funnel"].first().selected == sample["selected"].count()


def test_shapes_and_formats(spark):
    manifest = view(spark, DATA, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 5).alias("survey"), F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("structural_key"))
    got = programs.shape_report(view(spark, DATA, "cells"), view(spark, DATA, "merged"), manifest, 10)
    assert rows(got["shapes"]) == rows(queries.shape_counts(spark, DATA)) and got["queue"].count() == 10
    assert got["manifest"].count() == manifest.count() and got["manifest"].filter("shape IS NOT NULL").count() == got["files"].count()
    formats = programs.extension_breakdown(view(spark, DATA, "files"), 3)
    assert rows(formats["by_years"]) == rows(queries.year_bucket_crosstab(spark, DATA)) and formats["top_surveys"].count() == 3
    log = spark.createDataFrame([("a", "", 3, 3), ("b", "x", 0, 0)], "survey string, error string, number int, n_datasets int")
    assert programs.survey_sizes(log)["totals"].first().n_error == 1 and programs.survey_sizes(log)["errors"].first().survey == "b"


def test_rule_evidence(spark):
    kind = "struct<name:string,areas:array<struct<range:string,checks:array<struct<rule_id:string,tri_state:string,violations:array<struct<cell_range:string,description:string,violation_severity:string>>>>>>>"
    docs = spark.createDataFrame([("f1", [("s", [("A1", [("r1", "fail", [("A1", "d", "major"), ("A1", "d", "minor")]), ("r2", "pass", [])])])]), ("f2", [("s", [("A1", [("r1", "pass", [])])])])], f"stem string, sheets array<{kind}>")
    items = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "stem string")
    checks = spark.createDataFrame([("f1", "r1", False, False)], "stem string, rule_id string, passed boolean, skipped boolean")
    weights = spark.createDataFrame([("f1", 2, "g"), ("f2", 1, "g"), ("f3", 1, "h")], "stem string, weight int, org string")
    got = programs.rule_evidence(docs, items, checks, weights, "org")
    assert got["states"].count() == 6 and got["checks"].count() == 3
    assert [tuple(r) for r in got["violation_counts"].collect()] == [("f1", "r1", 1)] and got["rates"].count()
