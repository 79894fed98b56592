"""Domain operators: twins in DuckDB on the smallest tables, hand-worked values, properties, plans."""

import io
import os
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from gridmeter.functions import boxes as B
from gridmeter.functions import names as N
from gridmeter.functions import text as T
from gridmeter.functions.numeric import py_round, wilson_high, wilson_low
from gridmeter.operators import catalog, checks, evidence, fingerprint, layout, reports, rules, sampling, sensitivity
from gridmeter.plans import queries as Q
from gridmeter.plans.standins import view
from gridmeter.sources import keyed, sinks, tables, workbook
from gridmeter.streaming import incremental

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@needs_data
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_twins(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in Q.ORACLES:
        assert rows
        return
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    r = db.execute(Q.ORACLES[name])
    at = [[d[0] for d in r.description].index(c) for c in columns]
    assert rows == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())


def test_grids_hold_every_document(spark, tmp_path):
    """Cells by brute force, of documents on both sides of 400 and of large ids."""
    ids, rows, cols = [0, 1, 399, 400, 401, 9_999, 12_345_678], range(3), range(3)
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 3) for n in (1, 2, 3)], "l_linenumber int, l_suppkey int").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(d, r, c) for d in ids for r in rows for c in cols if (d + r) % 7 > 1 and r < 5 + d % 14 and (c > 0 or r > d % 3) and (r > 0 or c == 1)}
    got = [(x.doc, x.row, x.col) for x in view(spark, str(tmp_path), "cells").collect()]
    assert set(got) == want and len(got) == len(want)
    assert {x.doc: x.n_merged for x in view(spark, str(tmp_path), "merged").collect()} == {i: i % 11 for i in ids}
    assert {x.doc for x in Q.QUERIES["occupancy"](spark, str(tmp_path)).collect()} == {d for d, _, _ in want}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wilson_by_hand(spark):
    df = spark.createDataFrame([(253, 599), (0, 10), (10, 10), (0, 0)], "p long, n long")
    got = [(r.lo, r.hi) for r in df.select(wilson_low(F.col("p"), F.col("n")).alias("lo"), wilson_high(F.col("p"), F.col("n")).alias("hi")).collect()]
    assert (round(got[0][0], 4), round(got[0][1], 4)) == (0.3834, 0.4623)
    assert got[1][0] == 0 and got[2][1] == pytest.approx(1) and got[3] == (None, None)


def test_rounding_like_python(spark):
    df = spark.createDataFrame([(0.03125, 4), (0.00625, 4), (2.675, 2)], "x double, d int")
    assert [r[0] for r in df.select(py_round(F.col("x"), 4)).collect()] == [0.0312, 0.0063, 2.675]


STEMS = {
    "令和３年度 家計調査（第2回）東京都": "家計調査",
    "労働力調査_2020年1月_月報": "労働力調査_月報",
    "2015-2019 13東京 人口【】・、・概況": "人口 ・概況",  # a run of separators becomes one
    "人口((・)) 表": "人口 表",  # brackets around hollow ones are hollow
    "人口(] 表": "人口 表",
    "(概要) - a【平成元年】(速報)": "(概要) a (速報)",
    "((a) b ) c": "((a) b ) c",
    "((a)(2020年度)": "((a)",
    "a _ _ b": "a b",
    "a_ _b": "a_b",
    "H30年度 統計 １２月末現在": "統計",
    "北海道 統計": "統計",
    "_京都_統計": "統計",
    "東京都市圏": "市圏",
    " 、": "",
    "": "",
    None: "",
}


def test_titles(spark):
    df = spark.createDataFrame([(t,) for t in STEMS], "t string")
    assert {r.t: r.s for r in df.select("t", T.title_stem("t").alias("s")).collect()} == STEMS
    kept = one(spark, T.title_stem_with_region(F.lit("北海道 統計 2020年")), T.normal_name(F.lit(" Ａ　 b ")), T.normal_name(F.lit(None).cast("string")))
    assert tuple(kept) == ("北海道 統計", "A b", "")


def test_names_of_files(spark):
    c = lambda f, *xs: f(*map(F.lit, xs))
    got = one(spark, c(N.scoring_name, "d/a.b.xls"), c(N.scoring_name, "a.XLSX"), c(N.scoring_name, ".xls"), c(N.raw_path, "x\\x\\y", "t.1.xlsx"), c(N.raw_path, "x/xy", "t"), c(N.raw_path, "x", "t.xlsx"), c(N.raw_path, "x/x", "t.xlsx"))
    assert tuple(got) == ("a.b.xlsx", "a.XLSX", ".xls.xlsx", "x/y/t.1.xls", "x/xy/t.xls", "x/t.xls", "x/t.xls")
    got = one(spark, c(N.owner, "ann__x__1.xlsx"), c(N.survey_code, "0020_1_2.xlsx"), N.severity(F.lit(None).cast("int")), N.severity(F.lit("high")), N.organization(F.lit(None).cast("string")))
    assert tuple(got) == ("ann", "0020", None, "high", "その他集約")


def test_cells_of_the_plan(spark):
    cells = [(r.stat_type, r.organization) for r in N.cells(spark).orderBy("ord").collect()]
    assert len(set(cells)) == 20 and cells[0] == ("基幹統計", "総務省") and cells[5][1] == "その他集約" and cells[-1] == ("その他", "―")
    rows = spark.createDataFrame([("一般統計", "00450"), ("一般統計", "1"), ("その他", "00450"), ("?", "00450"), (None, None)], "t string, c string")
    got = [r[0] for r in rows.select(N.cell_id(N.cell_of(F.col("t"), F.col("c")))).collect()]
    assert got == ["一般統計×厚生労働省", "一般統計×その他集約", "その他×―", None, None]


def test_provenance(spark):
    row = N.with_provenance(spark.range(1), "2", "1.0", "strict", "n", source="s").first()
    assert row.provenance.asDict() == {"schema_version": "2", "checker_version": "1.0", "mode": "strict", "ai": "off", "note": "n", "source": "s"}


def test_weights_hashes_and_kinds(spark):
    weights = spark.createDataFrame([(x,) for x in ("3", "0", "-1", "x", "", None, "2.5")], "x string")
    assert [r[0] for r in weights.select(T.entry_weight(F.col("x"))).collect()] == [3, 1, 1, 1, 1, 1, 2.5]
    import hashlib

    got = one(spark, T.content_hash(F.lit(b"abc")), T.stable_seed(7, F.lit("k")), T.digest_id(F.lit("a"), F.lit("b")), T.is_blank(F.lit("\u3000 ")), T.is_blank(F.lit("x")))
    digest = hashlib.sha256(b"k").hexdigest()
    assert tuple(got) == (hashlib.sha256(b"abc").hexdigest()[:16], 7 + int(digest[:8], 16), hashlib.sha1(b"a\x1fb").hexdigest()[:16], True, False)


def test_surveys_by_folder_and_documents(spark, tmp_path):
    for code in ("001", "002"):
        (tmp_path / code).mkdir()
        (tmp_path / code / "rows.csv").write_text(f"a,b\n{code},0{code}\n", encoding="utf-8")
    rows = tables.csv_strings(spark, f"{tmp_path}/*/rows.csv", ["a", "b"]).withColumn("survey", tables.survey_of_path())
    assert sorted((r.survey, r.a, r.b) for r in rows.collect()) == [("001", "001", "0001"), ("002", "002", "0002")]
    (tmp_path / "good.json").write_text('{"n": 1,\n "s": "é"}', encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    assert [tuple(r) for r in tables.json_documents(spark, f"{tmp_path}/good.json", "n int, s string").collect()] == [(1, "é")]
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        tables.json_documents(spark, f"{tmp_path}/bad.json", "n int, s string").collect()


def test_write_back_leaves_other_rows(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, "z", 3)], "k string, v string, n int")
    new = spark.createDataFrame([("a", "X"), ("c", "W")], "k string, v string")
    assert sorted((r.k or "", r.v, r.n) for r in sinks.upsert(old, new, "k", ["v"]).collect()) == [("", "z", 3), ("a", "X", 1), ("b", "y", 2)]


def test_date_keys(spark):
    df = spark.createDataFrame([(x,) for x in ("", "2020", "202004", "2019-2020", "01234", None)], "x string")
    got = [tuple(r) for r in df.select(T.date_key(F.col("x")), T.date_value(F.col("x"))).collect()]
    assert got == [(-1, -1), (202000, 202000), (202004, 202004), (202000, 202000), (1234, 123400), (-1, -1)]


def test_numbers(spark):
    texts = {"1,234": True, "△5": True, "12%": True, "-": False, "1d": False, "1_000": True, "nan": True, " 3.5 ": True, "": False, "a": False, "▲1e3": True, ".5": True}
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert {r[0]: r[1] for r in df.select("x", T.is_numeric(F.col("x"))).collect()} == texts


def test_references(spark):
    refs = ["B3:F20", "A1", "AA10:AB12", "ZZ1", "nope", ""]
    df = spark.createDataFrame([(x,) for x in refs], "x string").withColumn("b", B.from_a1(F.col("x")))
    rows = df.select("b", B.to_a1(F.col("b")).alias("back")).collect()
    assert tuple(rows[0].b) == (2, 1, 19, 5) and tuple(rows[2].b) == (9, 26, 11, 27)
    assert [r.back for r in rows[:4]] == refs[:4] and rows[4].b is None and rows[5].b is None


def test_box_changes(spark):
    b = B.make(*map(F.lit, (2, 2, 8, 4)))
    take = lambda c: (lambda v: None if v is None else tuple(v))(one(spark, c)[0])
    edge = lambda b_, e, d: take(B.clamped(B.moved(b_, F.lit(e), F.lit(d)), F.lit(10), F.lit(5)))
    assert edge(b, "top", -2) == (1, 2, 8, 4) and edge(b, "right", 2) == (2, 2, 8, 5) and edge(b, "bottom", -7) is None
    assert take(B.grown(b, F.lit(-2))) is None and take(B.grown(b, F.lit(-1))) == (3, 3, 7, 3)
    parts = one(spark, B.bands(b, F.lit(3)))[0]
    assert [(p.first_row, p.last_row) for p in parts] == [(2, 4), (5, 6), (7, 8)]
    assert len(one(spark, B.bands(b, F.lit(4)))[0]) == 1


BOXES = "doc int, sheet string, idx int, first_row int, first_col int, last_row int, last_col int"


def test_matching_and_areas_by_brute_force(spark):
    import random

    rng = random.Random(2)
    box = lambda: (lambda r, c: (r, c, r + rng.randint(0, 4), c + rng.randint(0, 3)))(rng.randint(0, 4), rng.randint(0, 4))
    gt = [(d, "s", i, *box()) for d in range(40) for i in range(rng.randint(1, 4))]
    pred = [(d, "s", i, *box()) for d in range(45) for i in range(rng.randint(0, 4))]
    g, p = spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES)
    eob = {(r.doc, r.n): (r.tp, r.fp, r.fn) for r in layout.eob_by_sheet(g, p).collect()}
    areas = {r.doc: (r.gt_area, r.pred_area, r.inter_area) for r in layout.union_areas(g, p).collect()}
    cells = lambda b: {(r, c) for r in range(b[3], b[5] + 1) for c in range(b[4], b[6] + 1)}
    for d in range(40):
        a, b = [x for x in gt if x[0] == d], [x for x in pred if x[0] == d]
        ca, cb = set().union(*map(cells, a)), set().union(*map(cells, b))
        assert areas[d] == (len(ca), len(cb), len(ca & cb))
        for n in (0, 1, 2):
            every = []
            for x in a:
                for y in b:
                    err = max(abs(x[i] - y[i]) for i in range(3, 7))
                    if err <= n:
                        every.append((err, -len(cells(x) & cells(y)) / len(cells(x) | cells(y)), y[2], x[2]))
            used_p, used_g = set(), set()
            for _, _, i, j in sorted(every):
                if i not in used_p and j not in used_g:
                    used_p.add(i)
                    used_g.add(j)
            tp = len(used_p)
            assert eob[d, n] == (tp, len(b) - tp, len(a) - tp)
    assert len(areas) == 40 and eob == {(r.doc, r.n): (r.tp, r.fp, r.fn) for r in layout.eob_by_sheet(g.repartition(7), p.repartition(3)).collect()}


def test_execution_branches(spark):
    rows = [("L3-02", True, 1.0, "", True), ("L3-07", True, 1.0, "", True), ("L1-01", True, 0.0, "", True), ("L1-01", False, 1.0, "判定対象外です", True), ("L1-01", True, 1.0, "", True), ("L1-01", False, 1.0, "", True), ("L1-01", True, 1.0, "", False), ("L1-01", False, 1.0, None, False)]
    df = spark.createDataFrame(rows, "rule_id string, passed boolean, confidence double, message string, has boolean")
    df = df.withColumn("b", evidence.branch(F.col("rule_id"), F.col("passed"), F.lit(False), F.col("confidence"), F.col("message"), F.col("has")))
    got = [tuple(r) for r in df.select("b", evidence.tri_state(F.col("b"), F.col("passed"))).collect()]
    assert got == [("not_implemented", "abstain"), ("bulk_only", "abstain"), ("semantic_skip", "abstain"), ("semantic_skip", "abstain"), ("violation_checked", "pass"), ("violation_checked", "fail"), ("no_candidate", "pass"), ("violation_checked", "fail")]


def test_first_severity_and_last_row_win(spark):
    v = spark.createDataFrame([("f", "r", "s", "A1", "d", sev, o) for o, sev in ((2, "minor"), (1, "fatal"))], "stem string, rule_id string, sheet_name string, cell_range string, description string, severity string, ord int")
    assert evidence.unique_violations(v).first().severity == "fatal"
    assert rules.last_per_key(v, ["stem"], "ord").first().severity == "minor"


def test_shapes_by_hand(spark):
    base = {"has_data_row": True, "merged_ratio": 0.0, "body_numeric_ratio": 0.9, "max_blocks": 1, "n_sheets": 1, "header_depth": 1, "stub_ratio": 0.0, "corner_blank": False}
    cases = [({"has_data_row": False}, "paper_form"), ({"merged_ratio": 0.2, "body_numeric_ratio": 0.1}, "paper_form"), ({"max_blocks": 2}, "multi_table"), ({"n_sheets": 3}, "multi_table"), ({"stub_ratio": 0.8, "corner_blank": True}, "crosstab"), ({"header_depth": 2}, "multi_header"), ({}, "flat")]
    df = spark.createDataFrame([(base | c)for c, _ in cases])
    assert [r[0] for r in df.select(fingerprint.shape()).collect()] == [s for _, s in cases]


def test_blocks_and_headers(spark):
    grid = {0: ["title"], 2: ["", "a", "b"], 3: ["x", 1, 2], 4: ["y", 3, 4], 7: ["z", 5, 6], 8: ["z", 5, 6], 9: ["z", 5, 6]}
    rows = [("d", 0, r, c, str(v), isinstance(v, int)) for r, vs in grid.items() for c, v in enumerate(vs) if v != ""]
    cells = spark.createDataFrame(rows, "doc string, sheet int, row int, col int, value string, numeric boolean")
    f = fingerprint.sheet_features(cells, spark.createDataFrame([("d", 0, 2)], "doc string, sheet int, n_merged int")).first()
    assert (f.n_rows, f.n_cols, f.n_nonempty, f.n_blocks, f.header_depth, f.corner_blank, f.col_signature) == (10, 3, 18, 2, 1, True, "snn")
    assert fingerprint.row_blocks(fingerprint.row_profiles(cells)).count() == 2


def test_seeded_samples_are_stable(spark):
    rows = spark.createDataFrame([(f"c{i % 3}", i, i % 4) for i in range(200)], "cell string, id int, survey int")
    a = sorted(map(tuple, sampling.seeded_stratified(rows, "cell", "id", "survey", 10, 1).collect()))
    assert a == sorted(map(tuple, sampling.seeded_stratified(rows.repartition(5), "cell", "id", "survey", 10, 1).collect())) and len(a) == 30 and all(x[3] == "ok" for x in a)
    h = sampling.hash_stratified(rows, "cell", "id", 7, 1)
    assert h.count() == 21 and h.exceptAll(sampling.hash_stratified(rows.repartition(9), "cell", "id", 7, 1)).count() == 0
    assert sampling.flat_sample(rows, "id", 5, 3).count() == 5


def test_guards(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",), ("",)], "k string"), spark.createDataFrame([("x",), ("z",), ("",)], "k string")
    assert {tuple(r) for r in checks.join_problems(a, b, "k").collect()} >= {("x", "duplicate"), ("y", "missing"), ("z", "extra"), ("", "blank")}
    with pytest.raises(Exception, match="no such thing"):
        checks.require(a, F.col("k") == "x", "no such thing").collect()
    with pytest.raises(ValueError):
        checks.require_columns(a, ["k", "m"])
    assert checks.set_differences(a, b).count() == 3


def test_report_text(spark):
    row = one(spark, reports.percent(F.lit(0.12345)), reports.percent(F.lit(None).cast("double")), reports.typst_escape(F.lit("a#b$c_d@e")))
    assert tuple(row) == ("12.3%", "―", "a\\#b\\$c\\_d\\@e")
    assert reports.markdown(spark.range(1), ["id"]) == "| id |\n|---|\n| 0 |"


@needs_data
@pytest.mark.parametrize("name", ["rule_pass_rate", "file_rule_rollup", "violations_dedup", "template_dedup", "eob_micro", "union_areas", "iou_summary", "level_deltas"])
def test_plans_stay_in_the_engine(spark, name):
    plan = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


@needs_data
def test_scans_prune_columns(spark):
    plan = rules.file_rollup(view(spark, DATA, "checks"))._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "l_commitdate" not in plan and "PushedFilters" in plan


def xlsx(sheets):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="S{i}" sheetId="{i + 1}" r:id="r{i}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        for i, body in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData><mergeCells><mergeCell ref='A1:B1'/></mergeCells></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx(['<row><c r="A1" t="s"><v>0</v></c><c r="C2"><v>1.5</v></c><c r="D2"><f>A1+1</f></c><c r="E2"/></row>', '<row><c r="AA3" t="inlineStr"><is><t>in</t></is></c></row>']))
    spark.dataSource.register(workbook.WorkbookSource)
    rows = {tuple(r) for r in spark.read.format("workbook").load(str(tmp_path)).collect()}
    want = {("a.xlsx", 0, "S0", 0, 0, "shared", "str", 1), ("a.xlsx", 0, "S0", 1, 2, "1.5", "num", 1), ("a.xlsx", 0, "S0", 1, 3, "=A1+1", "formula", 1), ("a.xlsx", 1, "S1", 2, 26, "in", "str", 1)}
    assert rows == want
    files = tables.files(spark, str(tmp_path), "*.xlsx")
    assert {tuple(r) for r in workbook.cells_of(files).collect()} == want
    digest = checks.file_digests(files).first()
    assert len(digest.sha256) == 64 and digest.short == digest.sha256[:16]
    assert files.select(T.file_kind(F.col("content"))).first()[0] == "xlsx"


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("f1\ts1\ttrain\ta\\b\tB3:F20\tA1\t\tB3:F20\nshort\ts\n\ts\tt\tp\tA1\nf2\ts2\tdev\tc\\d\tC1:D2\n")
    rows = tables.ragged_ranges(spark, str(tmp_path / "r.tsv"))
    assert rows.count() == 3 and {tuple(r) for r in tables.corpus_index(rows).collect()} == {("f1", "a", 1, 2), ("f2", "c", 1, 1)}
    (tmp_path / "bad.tsv").write_text("f1\ts\tt\ta\\b\tA1\nf1\ts\tt\tc\\b\tA1\n")
    with pytest.raises(Exception, match="two paths"):
        tables.ragged_ranges(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "m1.json").write_text('{"entries": [{"file_name": "a.xls", "n": 1}, {"file_name": "a.xlsx", "n": 2}]}')
    (tmp_path / "m2.json").write_text('{"b.xls": {"n": 3}}')
    get = lambda p: {(r.name, r.n) for r in tables.manifest(spark, str(tmp_path / p)).select("name", F.try_variant_get("entry", "$.n", "int").alias("n")).collect()}
    assert get("m1.json") == {("a.xls", 1), ("a.xlsx", 2)} and get("m2.json") == {("b.xls", 3), ("b.xlsx", 3)}
    df = spark.createDataFrame([(1, [1, 2])], "k int, v array<int>")
    out = f"{tmp_path}/out.csv"
    assert sinks.write_once(df, out, "csv") and not sinks.write_once(df, out, "csv")
    assert tables.csv_strings(spark, out, ["k", "v"]).first().v == "[1,2]" and tables.row_count(spark, out) == 1
    assert keyed.cached(df.select("k"), lambda d: d.withColumn("x", F.col("k") * 2), f"{tmp_path}/cache", ["k"], "1").first().x == 2
    assert tables.latest_run(spark.createDataFrame([("2024-01-02",), ("zzz",), ("2023-05-05",)], "run string")).first().run == "2024-01-02"
    a = spark.createDataFrame([("f__1", "S", "0", "Table", "1", "1", " 2", "3"), ("f__1", "S", "0", "GroupHead", "1", "1", "1", "2"), ("f__1", "S", "0", "??", "1", "1", "1", "2")], tables.RANGES)
    assert tuple(tables.table_ranges(a).first())[3:] == (1, 1, 2, 3) and tables.cell_roles(a).count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i % 2}", i % 3 == 0, i % 5 == 0) for i in range(40)], "id int, rule_id string, passed boolean, skipped boolean")
    rows.write.parquet(f"{tmp_path}/in")
    for turn in range(2):
        incremental.append_new(incremental.stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", "id", f"{tmp_path}/check{turn}").awaitTermination()
        assert keyed.KeyedTable(spark, f"{tmp_path}/out", ["id"]).read().count() == 40
    q = incremental.running_rates(incremental.stream(spark, f"{tmp_path}/in", rows.schema)).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.rule_id, r.n, r.n_pass) for r in spark.table("rates").collect()} == {(r.rule_id, r.n, r.n_pass) for r in incremental.running_rates(rows).collect()}


def test_two_part_changes(spark):
    variants = {r.variant for r in sensitivity.variants(spark).collect()}
    assert len(variants) == 26 and {"shift_top-2", "expand_all2", "split_blank", "header-1", "detector"} <= variants
    log = spark.createDataFrame([("", 3, 3), ("", 3, 2), ("x", 3, 3)], "error string, number int, n_datasets int")
    assert [r.status for r in catalog.fetch_status(log).collect()] == ["ok", "incomplete", "error"]
