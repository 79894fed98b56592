"""Functions from SQL, and the small operators that no query shows."""

import json

from pyspark.sql import functions as F

from gridmeter.functions import sql
from gridmeter.functions import text as T
from gridmeter.operators import catalog, evidence, fingerprint, reports, sensitivity, tables

TITLES = ["令和3年度 人口（東京都）第3回", None, "", "a_(・)b 北海道", "統計（（年報））【 】2019〜2020年", "13東京_表1(", "Ａ １　x・・y", "平成元年3月末現在 x (a(・)b) )", "[・[、]] z"]


def test_titles_in_sql(spark):
    sql.register(spark)
    df = spark.createDataFrame([(t,) for t in TITLES], "title string")
    df.createOrReplaceTempView("titles")
    got = spark.sql("SELECT title, title_stem(title) AS a, title_stem_with_region(title) AS b, normal_name(title) AS c FROM titles")
    want = df.select("title", T.title_stem("title").alias("a"), T.title_stem_with_region("title").alias("b"), T.normal_name("title").alias("c"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [tuple(r) for r in spark.sql("SELECT py_round(2.675D, 2), py_round(0.5D, 0), nfkc('Ａ')").collect()] == [(2.67, 0.0, "A")]


def test_nested_checks_in_sql(spark):
    sql.register(spark)
    kind = "struct<name:string,areas:array<struct<range:string,checks:array<struct<rule_id:string,violations:array<struct<cell_range:string>>>>>>>"
    docs = spark.createDataFrame([(1, [("s1", [("A1:B2", [("r1", [("A1",), ("A2",)]), ("r2", None)]), ("C1", [])]), ("s2", None)]), (2, None), (3, [("s", [("A1", [("r1", [])])])])], f"stem long, sheets array<{kind}>")
    docs.createOrReplaceTempView("documents_nested")
    got = spark.sql("SELECT stem, sheet_no, sheet_name, area_no, range, check_no, rule_id, n_violations FROM flatten_checks(TABLE(documents_nested) PARTITION BY stem) ORDER BY stem, check_no")
    assert [tuple(r) for r in got.collect()] == [(1, 1, "s1", 1, "A1:B2", 1, "r1", 2), (1, 1, "s1", 1, "A1:B2", 2, "r2", 0), (3, 1, "s", 1, "A1", 1, "r1", 0)]
    native = evidence.flatten_checks(docs).select("stem", "sheet_no", "sheet_name", "area_no", "range", "check_no", "rule_id")
    assert sorted(map(tuple, native.collect())) == sorted(tuple(r)[:7] for r in got.collect())


def test_documents_stream_in_batches(spark):
    """No shuffle by document, and calls by batch: a null sheet, a null area and null arrays have no rows, as natively."""
    sql.register(spark)
    docs = spark.range(5000).selectExpr("id AS stem", """transform(sequence(1, int(id % 4)), s -> if(s = 2, null, named_struct('name', 's' || s, 'areas',
        transform(sequence(1, int(id % 3)), a -> if(id % 5 = 0 AND a = 2, null, named_struct('range', 'A' || a, 'checks',
        if(a = 1 AND id % 7 = 0, null, transform(sequence(1, int(id % 2 + 1)), c -> named_struct('rule_id', 'r' || c, 'violations', if(c = 2, null, array_repeat(named_struct('cell_range', 'x'), int(id % 6)))))))))))) AS sheets""")
    got = spark.sql("SELECT * FROM flatten_checks(TABLE({docs}))", docs=docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "Exchange" not in plan
    native = evidence.flatten_checks(docs).selectExpr("stem", "sheet_no", "sheet_name", "area_no", "range", "check_no", "rule_id", "coalesce(size(violations), 0) AS n")
    native = native.withColumn("n", F.greatest("n", F.lit(0)))
    want = sorted(map(tuple, native.collect()))
    assert len(want) > 5000 and sorted(map(tuple, got.collect())) == want


def test_header_moves(spark):
    schema = "doc int, sheet string, idx int, header_rows array<bigint>, body_start_row bigint, body_end_row bigint"
    regions = spark.createDataFrame([(1, "s", 0, [2, 0, 1], 3, 9), (2, "s", 0, [], 0, 4), (3, "s", 0, [0], 1, 1), (4, "s", 0, [0, 3], 5, 8)], schema)
    got = {(r.variant, r.doc): (r.header_rows, r.body_start_row, r.body_end_row) for r in sensitivity.header_moves(regions).collect()}
    none = (None, None, None)
    assert got == {
        ("header+1", 1): ([0, 1, 2, 3], 4, 9), ("header-1", 1): ([0, 1], 2, 9), ("header+1", 2): ([0], 1, 4), ("header-1", 2): none,
        ("header+1", 3): none, ("header-1", 3): ([], 0, 1), ("header+1", 4): ([0, 3, 5], 6, 8), ("header-1", 4): ([0], 3, 8),
    }


def test_resources_with_their_surveys(spark):
    resources = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "survey string, url string")
    frame = spark.createDataFrame([("1", "Census", "core", "x"), ("3", "Other", "core", "x")], "gov_stats_code string, gov_stats_name string, stats_type string, more string")
    assert sorted(map(str, map(tuple, catalog.with_frame(resources, frame).collect()))) == sorted(map(str, [("1", "a", "Census", "core"), ("2", "b", "", ""), (None, "c", "", "")]))


def test_error_records_documents_and_labels(spark):
    log = spark.createDataFrame([("a", "ok"), ("b", "error"), ("c", None), ("d", "error")], "file string, status string")
    assert sorted(r.file for r in tables.error_records(log).collect()) == ["b", "d"]
    text = tables.document(spark.createDataFrame([(1, "表", [1, 2])], "n int, name string, parts array<int>"))
    assert json.loads(text) == [{"n": 1, "name": "表", "parts": [1, 2]}] and "表" in text and text.startswith("[\n  {")
    manifest = spark.createDataFrame([(1, "flat", "k1"), (2, None, None), (3, "old", "k3")], "doc int, shape string, structural_key string")
    found = spark.createDataFrame([(2, "crosstab", "k2"), (3, "multi_table", None), (9, "flat", "k9")], "doc int, shape string, structural_key string")
    assert sorted(map(tuple, fingerprint.with_labels(manifest, found).collect())) == [(1, "flat", "k1"), (2, "crosstab", "k2"), (3, "multi_table", "k3")]


def test_conversion_status(spark):
    rows = spark.createDataFrame([(0, 0, 5), (1, 2, 5), (0, 2, 5), (3, 3, 0)], "missing int, empty int, cells int")
    status = reports.conversion_status(F.col("missing"), F.col("empty"), F.col("cells"))
    assert [r[0] for r in rows.select(status).collect()] == ["ok", "sheet_mismatch", "empty_range", "empty"]
