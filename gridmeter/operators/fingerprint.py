"""Workbook fingerprints over cell grids: row profiles, blocks, header depth, shape, structural keys.

cells: doc, sheet (order from 0), row, col (from 0), value, numeric. Blank cells have no row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the classification.
BLANK_GAP, MIN_ROWS, MIN_COLS, DATA_RATIO, TITLE_CELLS = 2, 3, 2, 0.6, 1
MERGED_MIN, FORM_NUMERIC_MAX, STUB_MIN, BODY_NUMERIC_MIN = 0.15, 0.35, 0.7, 0.6
SHAPES = ("paper_form", "multi_table", "crosstab", "multi_header", "flat")
SIGNATURE_CHARS = 120
KEYS = ["doc", "sheet"]


def row_profiles(cells: DataFrame) -> DataFrame:
    """doc, sheet, row, n, first_col, last_col, numeric_ratio (of cells outside column 0), stub_is_label, is_data."""
    body = F.col("col") > 0
    ratio = F.coalesce(F.try_divide(F.count_if(body & F.col("numeric")), F.count_if(body)), F.lit(0.0))
    p = cells.groupBy(*KEYS, "row").agg(F.count("*").alias("n"), F.min("col").alias("first_col"), F.max("col").alias("last_col"), ratio.alias("numeric_ratio"), F.count_if(body).alias("n_body"), (F.count_if((F.col("col") == 0) & ~F.col("numeric")) > 0).alias("stub_is_label"))
    return p.withColumn("is_data", (F.col("n_body") > 0) & (F.col("numeric_ratio") >= DATA_RATIO)).drop("n_body")


def row_blocks(profiles: DataFrame) -> DataFrame:
    """doc, sheet, block, n_rows, first_row, last_row, width, is_table: runs of rows without two blank ones between."""
    w = Window.partitionBy(*KEYS).orderBy("row")
    new = profiles.withColumn("new", F.coalesce((F.col("row") - F.lag("row").over(w) > BLANK_GAP).cast("int"), F.lit(0)))
    grouped = new.withColumn("block", F.sum("new").over(w)).groupBy(*KEYS, "block").agg(F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), (F.max("last_col") - F.min("first_col") + 1).alias("width"))
    return grouped.withColumn("is_table", (F.col("n_rows") >= MIN_ROWS) & (F.col("width") >= MIN_COLS))


def header_depth(profiles: DataFrame) -> DataFrame:
    """doc, sheet, start (the first row with several cells), first_data, header_depth (rows with cells between them)."""
    starts = profiles.groupBy(*KEYS).agg(F.min(F.when(F.col("n") > TITLE_CELLS, F.col("row"))).alias("start"), F.min("row").alias("top"), F.max("row").alias("bottom"))
    rows = profiles.join(starts, KEYS).filter(F.col("row") >= F.col("start"))
    data = rows.groupBy(*KEYS).agg(F.min(F.when(F.col("is_data"), F.col("row"))).alias("first_data"))
    depth = rows.join(data, KEYS).groupBy(*KEYS).agg(F.count_if(F.col("first_data").isNull() | (F.col("row") < F.col("first_data"))).alias("above"))
    out = starts.join(data, KEYS, "left").join(depth, KEYS, "left")
    capped = F.when(F.col("first_data").isNull(), F.least(F.coalesce("above", F.lit(0)), F.col("bottom") - F.col("top") + 1)).otherwise(F.col("above"))
    return out.select(*KEYS, "top", "bottom", "start", "first_data", capped.cast("long").alias("header_depth"))


def sheet_features(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """The features of each sheet with cells. merged: doc, sheet, n_merged (ranges)."""
    profiles = row_profiles(cells)
    size = profiles.groupBy(*KEYS).agg((F.max("last_col") + 1).alias("n_cols"), F.sum("n").alias("n_nonempty"))
    blocks = row_blocks(profiles).groupBy(*KEYS).agg(F.count_if("is_table").alias("n_blocks"))
    heads = header_depth(profiles)
    body = profiles.join(heads.select(*KEYS, "first_data"), KEYS).filter(F.col("row") >= F.col("first_data"))
    ratios = body.groupBy(*KEYS).agg(F.round(F.avg("numeric_ratio"), 4).alias("body_numeric_ratio"), F.round(F.avg(F.col("stub_is_label").cast("int")), 4).alias("stub_ratio"))
    placed = cells.join(heads, KEYS)
    corner = placed.groupBy(*KEYS).agg(F.bool_or((F.col("row") == F.col("start")) & (F.col("col") == 0)).alias("corner_used"))
    marks = placed.filter(F.col("row") == F.col("first_data")).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("col", F.when(F.col("numeric"), "n").otherwise("s")))).alias("marks"))
    out = size.join(blocks, KEYS).join(heads, KEYS).join(ratios, KEYS, "left").join(corner, KEYS).join(marks, KEYS, "left").join(merged, KEYS, "left")
    rows = F.col("bottom") - F.col("top") + 1
    signature = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.col("n_cols"), F.lit(SIGNATURE_CHARS)) - 1), lambda i: F.coalesce(F.try_element_at("marks", i.cast("int")), F.lit("-"))), "")
    return out.select(
        *KEYS, rows.alias("n_rows"), "n_cols", "n_nonempty", "n_blocks", "header_depth",
        F.try_divide(F.coalesce("n_merged", F.lit(0)), "n_nonempty").alias("merged_ratio"), F.try_divide("n_nonempty", rows * F.greatest("n_cols", F.lit(1))).alias("density"),
        F.coalesce("body_numeric_ratio", F.lit(0.0)).alias("body_numeric_ratio"), F.coalesce("stub_ratio", F.lit(0.0)).alias("stub_ratio"),
        F.coalesce((F.col("start") < F.col("first_data")) & ~F.col("corner_used"), F.lit(False)).alias("corner_blank"),
        F.col("first_data").isNotNull().alias("has_data_row"), F.when(F.col("first_data").isNotNull(), signature).otherwise("").alias("col_signature"),
    )


def file_features(sheets: DataFrame) -> DataFrame:
    """Sums over a file's sheets, and the features of the one with the most cells, the first of equal ones."""
    own = [c for c in sheets.columns if c not in (*KEYS, "n_nonempty")]
    grouped = sheets.groupBy("doc").agg(F.count("*").alias("n_sheets"), F.max("n_blocks").alias("max_blocks"), F.sum("n_nonempty").alias("total_nonempty"), F.max_by(F.struct(*own), F.struct("n_nonempty", -F.col("sheet"))).alias("d"))
    out = grouped.select("doc", "n_sheets", "max_blocks", "total_nonempty", "d.*")
    return out.withColumns({"merged_ratio": F.round("merged_ratio", 4), "density": F.round("density", 4)})


def shape() -> Column:
    crosstab = (F.col("header_depth") >= 1) & (F.col("stub_ratio") >= STUB_MIN) & F.col("corner_blank") & (F.col("body_numeric_ratio") >= BODY_NUMERIC_MIN)
    return (
        F.when(~F.col("has_data_row"), "paper_form")
        .when((F.col("merged_ratio") >= MERGED_MIN) & (F.col("body_numeric_ratio") < FORM_NUMERIC_MAX), "paper_form")
        .when(F.col("max_blocks") >= 2, "multi_table")
        .when(F.col("n_sheets") >= 2, "multi_table")
        .when(crosstab, "crosstab")
        .when(F.col("header_depth") >= 2, "multi_header")
        .otherwise("flat")
    )


def structural_key() -> Column:
    """16 hex digits over the features that tell one form from another; the ratio as Python prints it."""
    parts = [F.col(c).cast("string") for c in ("n_sheets", "n_cols", "header_depth", "max_blocks")]
    return F.substring(F.sha2(F.concat_ws("|", *parts, F.round("merged_ratio", 2).cast("string"), "col_signature").cast("binary"), 256), 1, 16)


def duplicates(files: DataFrame) -> DataFrame:
    """key, n_files, n_surveys, cross_survey of the structural keys that several files have. files: doc, survey, structural_key."""
    groups = files.groupBy("structural_key").agg(F.count("*").alias("n_files"), F.countDistinct("survey").alias("n_surveys")).filter("n_files > 1")
    return groups.withColumn("cross_survey", F.col("n_surveys") > 1)


def shape_counts(files: DataFrame) -> DataFrame:
    """shape, n in the fixed order of shapes, those without files too."""
    order = files.sparkSession.createDataFrame(list(enumerate(SHAPES)), "ord int, shape string")
    return order.join(files.groupBy("shape").agg(F.count("*").alias("n")), "shape", "left").fillna(0, ["n"]).orderBy("ord")


def with_labels(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """manifest with shape and structural_key set where found has the file; other rows stay as they are."""
    new = found.select("doc", F.col("shape").alias("s"), F.col("structural_key").alias("k"))
    return manifest.join(new, "doc", "left").withColumns({"shape": F.coalesce("s", "shape"), "structural_key": F.coalesce("k", "structural_key")}).drop("s", "k")
