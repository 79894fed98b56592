"""Steps whose tasks must not grow with the tables: partitions by count, and plans without wide rows."""

import os
import re

import pytest
from pyspark.sql import functions as F

from gridmeter.operators import layout, sensitivity
from gridmeter.plans import queries as Q
from gridmeter.plans import standins
from gridmeter.plans.standins import view
from gridmeter.sources import scratch

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["checks", "violations", "gt"])
def test_lines_are_dealt_by_order_and_count(spark, monkeypatch, name):
    whole = sorted(map(str, view(spark, DATA, name).collect()))
    monkeypatch.setattr(scratch, "ROWS_OF_PART", 500)
    df = view(spark, DATA, name)
    lines = view(spark, DATA, "lineitem").count()
    assert sorted(map(str, df.collect())) == whole
    places = df.select(df.columns[0], F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in places.groupBy("p").count().collect()]
    assert len(sizes) >= lines // 500 and max(sizes) < 1000
    assert places.distinct().groupBy(df.columns[0]).count().filter("count > 1").isEmpty()


@needs_data
def test_dealt_rows_are_not_held_by_the_tasks_that_read_them(spark, monkeypatch):
    """More partitions than a shuffle writes directly would have each reading task sort all its rows in memory."""
    lines = view(spark, DATA, "lineitem")
    rows = lines.count()
    monkeypatch.setattr(scratch, "ROWS_OF_PART", rows // 1000)
    assert scratch.parts(lines) == scratch.parts(lines, lines) == 200
    p = plan(Q.QUERIES["rule_pass_rate"](spark, DATA))
    assert {int(n) for n in re.findall(r"hashpartitioning\((?:l|o)_orderkey#\d+L?, (\d+)\)", p)} == {200}
    monkeypatch.setattr(scratch, "ROWS_OF_PART", 1)  # tables beyond the most rows of a partition
    assert scratch.parts(lines) == -(-rows // 15)


@needs_data
def test_perturbed_boxes_are_columns(spark):
    """No arrays of boxes, no shuffle by 22 variants of each table."""
    p = plan(Q.QUERIES["variant_boxes"](spark, DATA))
    assert "named_struct" not in p and "Generate posexplode" not in p
    shuffles = re.findall(r"Exchange hashpartitioning\((.*?)\)", plan(Q.QUERIES["variant_counts"](spark, DATA)))
    assert not any("idx" in s for s in shuffles)


def test_perturbed_boxes_by_hand(spark):
    schema = "doc int, sheet string, idx int, first_row int, first_col int, last_row int, last_col int"
    tables = spark.createDataFrame([(1, "s", 0, 2, 1, 8, 3), (1, "s", 1, 10, 2, 10, 2), (2, None, 0, 1, 1, 6, 1)], schema)
    sheets = spark.createDataFrame([(1, "s", 10, 3)], "doc int, sheet string, max_row int, max_col int")
    got = sensitivity.perturbed(tables, sheets)
    assert dict(got.dtypes) == {"variant": "string", "doc": "int", "sheet": "string", "idx": "int", "part": "int"} | dict.fromkeys(("first_row", "first_col", "last_row", "last_col"), "bigint")
    boxes = {(r.variant, r.idx, r.part): tuple(r)[5:] for r in got.collect()}
    assert boxes["shift_top-2", 0, 0] == (1, 1, 8, 3) and boxes["shift_bottom+2", 0, 0] == (2, 1, 10, 3) and boxes["expand_all2", 0, 0] == (1, 1, 10, 3)
    assert boxes["shrink_all1", 0, 0] == (3, 2, 7, 2) and ("shrink_all2", 0, 0) not in boxes and ("shift_bottom-1", 1, 0) not in boxes
    assert [boxes["split_3", 0, i] for i in range(3)] == [(2, 1, 4, 3), (5, 1, 6, 3), (7, 1, 8, 3)] and boxes["split_3", 1, 0] == (10, 2, 10, 2) and ("split_3", 1, 1) not in boxes
    counts = {r.variant: (r.n_tables, r.n_perturbed, r.n_dropped) for r in sensitivity.perturbation_counts(tables, got).collect()}
    assert counts["split_2"] == (3, 3, 1) and counts["shrink_all1"] == (3, 1, 2) and "shrink_all2" not in counts
    # sizes as columns: a table without a sheet is split, and not moved
    known = tables.withColumns({"max_row": F.lit(10), "max_col": F.lit(3)})
    alone = [r.variant for r in sensitivity.perturbed(known).filter("doc = 2").collect()]
    assert sorted(alone) == ["split_2"] * 2 + ["split_3"] * 3


@needs_data
def test_matches_compute_the_truth_once(spark, monkeypatch):
    """Predictions derive from the truth; counts and matches of a sheet are one aggregate, not joins of three."""
    seen = []

    def spied(spark, sf_dir, name, **given):
        seen.append(name)
        return view(spark, sf_dir, name, **given)

    monkeypatch.setattr(Q, "view", spied)
    monkeypatch.setattr(standins, "view", spied)
    df = Q.QUERIES["eob_match"](spark, DATA)
    assert seen.count("gt") == 1 and seen.count("pred") == 1
    assert "Join" not in plan(df)


def test_predictions_of_null_sheets_are_of_none(spark):
    box = "doc int, sheet string, idx int, first_row int, first_col int, last_row int, last_col int"
    gt = spark.createDataFrame([(1, None, 0, 0, 0, 1, 1), (1, "s", 0, 0, 0, 1, 1)], box)
    pred = spark.createDataFrame([(1, None, 0, 0, 0, 1, 1), (1, "s", 0, 0, 0, 1, 1), (2, "s", 0, 0, 0, 1, 1)], box)
    got = layout.eob_by_sheet(gt, pred).filter("n = 0").collect()
    assert sorted(tuple(r)[:6] for r in got if r.sheet) == [(1, "s", 0, 1, 0, 0)] and [tuple(r)[2:6] for r in got if not r.sheet] == [(0, 0, 0, 1)] and len(got) == 2


def test_best_overlaps_are_dealt_by_count(spark, monkeypatch):
    boxes = spark.range(60).selectExpr("id % 3 AS doc", "'s' AS sheet", "id AS idx", "id * 5 AS first_row", "0L AS first_col", "id * 5 + 3 AS last_row", "2L AS last_col")
    monkeypatch.setattr(scratch, "ROWS_OF_PART", 10)
    got = layout.best_iou(boxes, boxes)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 6
    assert sorted((r.side, r.idx, r.best) for r in got.collect()) == [(s, i, 1.0) for s in ("gt", "pred") for i in range(60)]
