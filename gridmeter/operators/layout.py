"""Layout quality: box pairs, greedy matching, union areas, overlap distributions, cell roles.

Boxes are 0-based and inclusive. gt and pred have doc, sheet, idx (order in the sheet) and the four sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.numeric import harmonic, precision, ratio_or_zero, recall
from ..sources.scratch import dealt, parts, written
from . import selection, spatial

KEYS = ["doc", "sheet"]
ROLES = ("Header", "Data", "Other")
#: A range that spans more rows or columns than this (by difference) isn't expanded to cells.
SPAN_LIMIT = 10_000
TOLERANCES = (0, 1, 2)


def _boxes(df: DataFrame, name: str) -> DataFrame:
    return df.select(*KEYS, F.col("idx").cast("int").alias(f"{name}i"), B.box().alias(name))


def kept(df: DataFrame) -> DataFrame:
    """Boxes that several steps read, written once."""
    return written(df.select(*KEYS, "idx", *B.SIDES))


def visible(pred: DataFrame) -> DataFrame:
    """Predictions that don't abstain."""
    return pred.filter(~F.coalesce("abstain", F.lit(False)))


def pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """All box pairs of a sheet, with boundary error and IoU. Sheets are the equi-key."""
    return _measured(_boxes(gt, "g").join(_boxes(pred, "p"), KEYS))


def _measured(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "pi", "gi", B.boundary_error(F.col("p"), F.col("g")).cast("int").alias("be"), B.iou(F.col("p"), F.col("g")).alias("iou"))


def close_pairs(gt: DataFrame, pred: DataFrame, most: int = max(TOLERANCES)) -> DataFrame:
    """The pairs with a boundary error of at most `most`, by buckets of all four sides."""
    return _measured(spatial.close_boxes(_boxes(gt, "g"), _boxes(pred, "p"), KEYS, "g", "p", most))


def overlapping_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """The pairs with an IoU above 0, by tiles."""
    return _measured(spatial.overlapping_boxes(_boxes(gt, "g"), _boxes(pred, "p"), KEYS, "g", "p"))


def greedy_matches(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """doc, sheet, be, pi, gi, iou: one-to-one pairs, by ascending (error, -IoU, prediction, truth). Those within a smaller tolerance are the matches for it.

    A round takes every pair that is the first one left for its prediction and for its truth: greedy order takes it too,
    as nothing before it holds either box. What shares a box with a taken pair goes; rounds end when no pair is left.
    Only predictions with several pairs are met again after their truths: mostly few.
    """
    first = F.struct("be", (-F.col("iou")).alias("neg"), "pi", "gi")
    left, taken = close_pairs(gt, pred).withColumn("first", first), []
    of_p, of_g = Window.partitionBy(*KEYS, "pi"), Window.partitionBy(*KEYS, "gi")
    while True:
        best = left.withColumns({"best_p": F.min("first").over(of_p), "of_p": F.count("*").over(of_p)}).withColumn("best_g", F.min("first").over(of_g))
        best = best.withColumn("takes", (F.col("first") == F.col("best_p")) & (F.col("first") == F.col("best_g"))).withColumn("gone", F.max("takes").over(of_g))
        best = written(best.filter("takes OR NOT gone").select(*left.columns, "takes", "of_p"))
        taken.append(best.filter("takes").select(*KEYS, "be", "pi", "gi", "iou"))
        if best.filter("NOT takes").isEmpty():
            return reduce(DataFrame.unionByName, taken)
        left = best.filter("NOT takes OR of_p > 1").withColumn("gone", F.max("takes").over(of_p)).filter("NOT gone").select(*left.columns)


def eob_by_sheet(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """doc, sheet, n (tolerance), tp, fp, fn, iou_sum of every sheet with truth; predictions on others are ignored."""
    gt, pred = kept(gt), kept(pred)
    within = lambda n: F.col("be") <= n
    one = lambda df, g, p: df.select(*KEYS, F.lit(g).alias("g"), F.lit(p).alias("p"))
    boxes = one(gt, 1, 0).unionByName(one(pred.dropna(subset=KEYS), 0, 1))  # a null key is no prediction's sheet
    rows = boxes.unionByName(greedy_matches(gt, pred).select(*KEYS, "be", "iou"), allowMissingColumns=True)
    sheets = rows.groupBy(*KEYS).agg(F.count_if(F.col("g") == 1).alias("n_gt"), F.count_if(F.col("p") == 1).alias("n_pred"), *(c for n in TOLERANCES for c in (F.count_if(within(n)).alias(f"tp{n}"), F.sum(F.when(within(n), F.col("iou"))).alias(f"sum{n}"))))
    sheets = sheets.filter("n_gt > 0")
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.coalesce(f"tp{n}", F.lit(0)).cast("int").alias("tp"), F.coalesce(f"sum{n}", F.lit(0.0)).alias("iou_sum")) for n in TOLERANCES))
    rows = sheets.select(*KEYS, "n_gt", "n_pred", F.inline(each))
    return rows.select(*KEYS, "n", "tp", (F.coalesce("n_pred", F.lit(0)) - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), "iou_sum")


def eob(by_sheet: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and scores over the sheets of each of keys and tolerance n."""
    s = by_sheet.groupBy(*keys, "n").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum")))
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return s.withColumns({"precision": p, "recall": r, "f1": harmonic(p, r), "mean_iou": ratio_or_zero(F.col("iou_sum"), F.col("tp"))})


def union_areas(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """doc, sheet, gt_area, pred_area, inter_area: cells that any truth, any prediction, and both cover; for sheets with truth."""
    return spatial.union_areas(gt, pred, KEYS, ("gt_area", "pred_area", "inter_area"))


def coverage(areas: DataFrame, keys: list[str]) -> DataFrame:
    s = areas.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("gt_area", "pred_area", "inter_area")))
    c, p = ratio_or_zero(F.col("inter_area"), F.col("gt_area")), ratio_or_zero(F.col("inter_area"), F.col("pred_area"))
    return s.withColumns({"coverage": c, "purity": p, "f1": harmonic(c, p)})


def best_iou(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """doc, sheet, side (gt or pred), idx, best: each box's best IoU with the other side; predictions of sheets without truth are ignored."""
    gt, pred = kept(gt), kept(pred)
    one = lambda name, i: F.struct(F.lit(name).alias("side"), F.col(i).cast("int").alias("idx"))
    met = overlapping_pairs(gt, pred).select(*KEYS, F.inline(F.array(one("gt", "gi"), one("pred", "pi"))), F.col("iou").alias("best"))
    alone = [df.select(*KEYS, F.lit(name).alias("side"), F.col("idx").cast("int").alias("idx"), F.lit(0.0).alias("best")) for df, name in ((gt, "gt"), (pred.join(gt.select(*KEYS).distinct(), KEYS, "left_semi"), "pred"))]
    each = [*KEYS, "side", "idx"]
    return dealt(alone[0].unionByName(alone[1]).unionByName(met), parts(gt, pred), *each).groupBy(*each).agg(F.max("best").alias("best"))


def summarize(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, quantiles (linear), shares at 0, from .5 and from .9. Equal values count as one row; quantiles are exact."""
    counted = written(values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")))
    shares = {"share_zero": F.col("value") == 0, "share_ge_05": F.col("value") >= 0.5, "share_ge_09": F.col("value") >= 0.9}
    n = F.sum("n")
    sums = counted.groupBy(*keys).agg(n.alias("n"), (F.sum(F.col("value") * F.col("n")) / n).alias("mean"), *((F.sum(F.when(c, F.col("n")).otherwise(0)) / n).alias(k) for k, c in shares.items()))
    quantiles = selection.quantiles(counted, keys, {f"p{q}": q / 100 for q in (10, 25, 50, 75, 90)})
    return selection.joined(sums, quantiles, keys).select(*keys, "n", "mean", *(f"p{q}" for q in (10, 25, 50, 75, 90)), *shares)


def histogram(values: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """Counts of equal bins of [0, 1], the last one closed; empty bins too."""
    binned = values.select(*keys, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    grid = values.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(binned, [*keys, "bin"], "left").fillna(0, ["n"])


def role_confusion(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn and scores of each role. truth and pred: keys, ord, role; the last of equal keys counts; a cell without prediction is Other."""
    from .rules import last_per_key

    t = last_per_key(truth, keys, "ord").select(*keys, F.col("role").alias("truth"))
    p = last_per_key(pred, keys, "ord").select(*keys, F.col("role").alias("guess"))
    cells = t.join(p, keys, "left").select("truth", F.coalesce("guess", F.lit("Other")).alias("guess"))
    marks = cells.select(F.inline(F.when(F.col("truth") == F.col("guess"), F.array(_mark(F.col("truth"), 1, 0, 0))).otherwise(F.array(_mark(F.col("truth"), 0, 0, 1), _mark(F.col("guess"), 0, 1, 0)))))
    sums = marks.groupBy("role").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    roles = truth.sparkSession.createDataFrame([(r,) for r in ROLES], "role string")
    out = roles.join(sums, "role", "left").fillna(0, ["tp", "fp", "fn"])
    pr, rc = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return out.withColumns({"support": F.col("tp") + F.col("fn"), "precision": pr, "recall": rc, "f1": harmonic(pr, rc)})


def _mark(role: Column, tp: int, fp: int, fn: int) -> Column:
    return F.struct(role.alias("role"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))


def macro_f1(confusion: DataFrame, digits: int = 4) -> DataFrame:
    """The mean of the rounded F1 of all roles, those without support included."""
    return confusion.agg(F.round(F.avg(F.round("f1", digits)), digits).alias("macro_f1"))


def expand_cells(ranges: DataFrame, columns: list[str]) -> DataFrame:
    """columns, row, col of every cell of ranges (the four sides); ranges that span too much are left out."""
    fits = (F.col("last_row") - F.col("first_row") <= SPAN_LIMIT) & (F.col("last_col") - F.col("first_col") <= SPAN_LIMIT)
    some = ranges.filter(fits & (F.col("last_row") >= F.col("first_row")) & (F.col("last_col") >= F.col("first_col")))
    return some.select("*", F.explode(F.sequence("first_row", "last_row")).alias("row")).select("*", F.explode(F.sequence("first_col", "last_col")).alias("col")).select(*columns, "row", "col")


def cells_in_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """cells (doc, sheet, row, col, value) in regions (doc, sheet, the four sides, header_rows): with Header or Data."""
    c, r = cells.filter(F.col("value").isNotNull()).alias("c"), regions.alias("r")
    inside = F.expr("c.doc = r.doc AND c.sheet = r.sheet AND c.row BETWEEN r.first_row AND r.last_row AND c.col BETWEEN r.first_col AND r.last_col")
    return c.join(r, inside).select("c.doc", "c.sheet", "c.row", "c.col", F.when(F.array_contains("r.header_rows", F.col("c.row")), "Header").otherwise("Data").alias("role"))


def cells_outside(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells with a value that no region of their sheet holds."""
    c, r = cells.filter(F.col("value").isNotNull()).alias("c"), regions.alias("r")
    inside = F.expr("c.doc = r.doc AND c.sheet = r.sheet AND c.row BETWEEN r.first_row AND r.last_row AND c.col BETWEEN r.first_col AND r.last_col")
    return c.join(r, inside, "left_anti")


def empty_ranges(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Regions that hold no cell with a value."""
    r, c = regions.alias("r"), cells.filter(F.col("value").isNotNull()).alias("c")
    return r.join(c, F.expr("c.doc = r.doc AND c.sheet = r.sheet AND c.row BETWEEN r.first_row AND r.last_row AND c.col BETWEEN r.first_col AND r.last_col"), "left_anti")


def evaluation_summary(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: tables, predictions on sheets with truth, their ratio."""
    on = pred.join(gt.select(*KEYS).distinct(), KEYS, "left_semi").agg(F.count("*").alias("n_pred"))
    return gt.agg(F.count("*").alias("n_gt")).crossJoin(on).withColumn("ratio", F.round(F.try_divide("n_pred", "n_gt"), 6))  # one row each
