"""Score sensitivity: perturbed layouts, and what changes from the baseline to a variant. Boxes here are 1-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B


def variants(spark: SparkSession) -> DataFrame:
    """variant, kind, edge, delta, k: 16 edge shifts, 4 growths, 3 splits, 2 header moves and the detector."""
    rows = [(f"shift_{edge}{d:+d}", "shift", edge, d, 0) for edge in ("top", "bottom", "left", "right") for d in (-2, -1, 1, 2)]
    rows += [(f"{name}_all{d}", "grow", "", sign * d, 0) for d in (1, 2) for name, sign in (("expand", 1), ("shrink", -1))]
    rows += [("split_blank", "split_blank", "", 0, 0), ("split_2", "split_equal", "", 0, 2), ("split_3", "split_equal", "", 0, 3)]
    rows += [("header+1", "header", "", 1, 0), ("header-1", "header", "", -1, 0), ("detector", "detector", "", 0, 0)]
    return spark.createDataFrame(rows, "variant string, kind string, edge string, delta int, k int")


def _steps(spark: SparkSession) -> DataFrame:
    """variant, part, k and the steps of the four sides, of the variants that need no cell contents: 25 rows, one for each box that a variant may make of one."""
    edge = dict(zip(B.SIDES, ("top", "left", "bottom", "right"), strict=True))
    out = lambda s: F.lit(-1 if s.startswith("first") else 1)
    step = lambda s: F.when(F.col("kind") == "grow", out(s) * F.col("delta")).when(F.col("edge") == edge[s], F.col("delta")).otherwise(0)
    specs = variants(spark).filter(F.col("kind").isin("shift", "grow", "split_equal")).select("variant", "k", *(step(s).alias(f"{s}_step") for s in B.SIDES))
    return specs.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest("k", F.lit(1)) - 1)))


def perturbed(tables: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """variant, doc, sheet, idx, part and the four sides of all boxes under the variants that need no cell contents.

    tables: doc, sheet, idx, sides (1-based); sheets: doc, sheet, max_row, max_col, which may be columns of tables instead. Boxes that turn
    inside out or leave the sheet drop out. All is arithmetic on columns of one join with the 25 steps: no row holds an array of boxes.
    """
    known = tables if sheets is None else tables.join(sheets, ["doc", "sheet"])
    rows = known.crossJoin(F.broadcast(_steps(tables.sparkSession)))  # 25 rows
    moved = {s: F.col(s) + F.col(f"{s}_step") for s in B.SIDES}
    cut = {"first_row": F.greatest(moved["first_row"], F.lit(1)), "first_col": F.greatest(moved["first_col"], F.lit(1)), "last_row": F.least(moved["last_row"], "max_row"), "last_col": F.least(moved["last_col"], "max_col")}
    proper = lambda b: (b["first_row"] <= b["last_row"]) & (b["first_col"] <= b["last_col"])
    # bands of a split: k of them, or the box itself where it has under 2 k rows
    n = F.col("last_row") - F.col("first_row") + 1
    whole = ~F.coalesce(n >= 2 * F.col("k"), F.lit(False))
    start = lambda i: F.col("first_row") + i * F.floor(n / F.col("k")) + F.least(i, n % F.col("k"))
    band = {s: F.col(s) for s in B.SIDES} | {"first_row": F.when(whole, F.col("first_row")).otherwise(start(F.col("part"))), "last_row": F.when(whole, F.col("last_row")).otherwise(start(F.col("part") + 1) - 1)}
    split = F.col("k") > 0
    known_sheet = F.col("doc").isNotNull() & F.col("sheet").isNotNull()
    kept = rows.filter(F.when(split, ~whole | (F.col("part") == 0)).otherwise(known_sheet & proper(moved) & proper(cut)))
    return kept.select("variant", "doc", "sheet", "idx", "part", *(F.when(split, band[s]).otherwise(cut[s]).cast("long").alias(s) for s in B.SIDES))


REGION = "struct<header_rows:array<bigint>,body_start_row:bigint,body_end_row:bigint>"


def moved_header(region: Column, delta: int) -> Column:
    """A region's layout (header_rows, body_start_row, body_end_row) with the header one row longer or shorter; null where that can't be.

    Longer: the first body row becomes a header row, unless it is the body's last. Shorter: the last header row becomes the first body row.
    """
    rows, start, end = region["header_rows"], region["body_start_row"], region["body_end_row"]
    layout = lambda rows, start: F.struct(F.array_sort(rows).alias("header_rows"), start.alias("body_start_row"), end.alias("body_end_row")).cast(REGION)
    if delta == 1:
        return F.when(start + 1 <= end, layout(F.array_union(rows, F.array(start)), start + 1))
    if delta == -1:
        last = F.array_max(rows)
        return F.when(F.size(rows) > 0, layout(F.array_except(rows, F.array(last)), last))
    raise ValueError(f"a header moves by one row, not by {delta}")


def header_moves(regions: DataFrame) -> DataFrame:
    """variant (header+1, header-1), the region's keys and its layout after the move, all null where it can't be moved.

    regions: doc, sheet, idx, header_rows (an array), body_start_row, body_end_row.
    """
    region = F.struct(*(F.col(c) for c in ("header_rows", "body_start_row", "body_end_row"))).cast(REGION)
    moves = F.array(*(F.struct(F.lit(f"header{d:+d}").alias("variant"), moved_header(region, d).alias("region")) for d in (1, -1)))
    return regions.select("doc", "sheet", "idx", F.inline(moves)).select("variant", "doc", "sheet", "idx", "region.*")


def perturbation_counts(tables: DataFrame, changed: DataFrame) -> DataFrame:
    """variant, n_tables, n_perturbed (boxes after), n_dropped (tables of which nothing is left).

    doc, sheet and idx name one table, and the parts of what a variant makes of it count from 0: part 0 stands for the table, and no keys are compared.
    """
    total = tables.agg(F.count("*").alias("n_tables"))
    kept = changed.groupBy("variant").agg(F.count("*").alias("n_perturbed"), F.count_if(F.col("part") == 0).alias("n_kept"))
    return kept.crossJoin(F.broadcast(total)).select("variant", "n_tables", "n_perturbed", (F.col("n_tables") - F.col("n_kept")).alias("n_dropped"))  # one row


def split_at_blank_rows(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """doc, sheet, idx, part and rows of the runs of rows with a value in each table; a table without any stays whole."""
    t, c = tables.alias("t"), cells.filter(F.col("value").isNotNull()).alias("c")
    inside = F.expr("c.doc = t.doc AND c.sheet = t.sheet AND c.row BETWEEN t.first_row AND t.last_row AND c.col BETWEEN t.first_col AND t.last_col")
    rows = t.join(c, inside, "left").select("t.*", "c.row").distinct()
    w = Window.partitionBy("doc", "sheet", "idx").orderBy("row")
    new = rows.withColumn("new", F.coalesce((F.col("row") - F.lag("row").over(w) > 1).cast("int"), F.lit(0)))
    runs = new.withColumn("part", F.sum("new").over(w))
    grouped = runs.groupBy("doc", "sheet", "idx", "part").agg(F.min("row").alias("a"), F.max("row").alias("b"), *(F.first(s).alias(s) for s in B.SIDES))
    return grouped.select("doc", "sheet", "idx", "part", F.coalesce("a", "first_row").alias("first_row"), "first_col", F.coalesce("b", "last_row").alias("last_row"), "last_col")


def level_deltas(base: DataFrame, variant: DataFrame) -> DataFrame:
    """By level: pairs with both scores, changed, unchanged share, mean, mean absolute, median and largest change; flips to and from null; forced zeros."""
    b, v = base.select("file", "level", F.col("score").alias("b"), F.col("forced_zero").alias("fb")), variant.select("file", "level", F.col("score").alias("v"), F.col("forced_zero").alias("fv"))
    rows = b.join(v, ["file", "level"]).withColumn("d", F.col("v") - F.col("b"))
    one = F.col("b").isNull() != F.col("v").isNull()
    return rows.groupBy("level").agg(
        F.count("d").alias("n"), F.count_if(F.col("d") != 0).alias("n_changed"), F.try_divide(F.count_if(F.col("d") == 0), F.count("d")).alias("unchanged"), F.avg("d").alias("mean"), F.avg(F.abs("d")).alias("mean_abs"),
        F.median("d").alias("median"), F.max(F.abs("d")).alias("max_abs"), F.count_if(one).alias("n_null_flips"), F.count_if("fb").alias("n_forced_base"), F.count_if("fv").alias("n_forced_variant"),
    )


def rule_transitions(base: DataFrame, variant: DataFrame) -> DataFrame:
    """rule_id, transition ('pass->fail'), n, of (file, rule) states that differ; a state that one side lacks is absent."""
    both = base.select("file", "rule_id", F.col("state").alias("b")).join(variant.select("file", "rule_id", F.col("state").alias("v")), ["file", "rule_id"], "full")
    rows = both.fillna("absent", ["b", "v"]).filter("b <> v")
    return rows.groupBy("rule_id", F.concat_ws("->", "b", "v").alias("transition")).agg(F.count("*").alias("n"))


def flip_rates(base: DataFrame, states: DataFrame, families: DataFrame) -> DataFrame:
    """rule_id, family, n_pairs, flip_rate in percent over (file, rule, variant) that both have. states: file, rule_id, variant, state; families: variant, family."""
    b = base.select("file", "rule_id", F.col("state").alias("b"))
    rows = states.join(F.broadcast(families), "variant").join(b, ["file", "rule_id"])
    return rows.groupBy("rule_id", "family").agg(F.count("*").alias("n_pairs"), (F.avg((F.col("state") != F.col("b")).cast("int")) * 100).alias("flip_rate"))


def all_levels_unchanged(base: DataFrame, variant: DataFrame) -> DataFrame:
    """file, unchanged: whether all its levels have the same score, null like null."""
    rows = base.select("file", "level", F.col("score").alias("b")).join(variant.select("file", "level", F.col("score").alias("v")), ["file", "level"])
    return rows.groupBy("file").agg(F.bool_and(F.col("b").eqNullSafe(F.col("v"))).alias("unchanged"))


def over_split(eob_by_file: DataFrame) -> DataFrame:
    """Files without a match within two cells for which more tables are predicted than there are. eob_by_file: doc, n, tp, fp, fn."""
    rows = eob_by_file.filter((F.col("n") == 2) & (F.col("tp") == 0))
    return rows.filter((F.col("tp") + F.col("fp") > F.col("tp") + F.col("fn")) & (F.col("tp") + F.col("fn") > 0)).select("doc", F.col("fp").alias("n_pred"), F.col("fn").alias("n_gt"))
