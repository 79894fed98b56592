"""Scans of catalogues, annotations and results, as DataFrames of plain strings or with schemas; no inference anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import boxes as B
from ..operators.checks import require

# Annotation labels by role.
ROLE_OF_LABEL = {"Header": "Header", "GroupHead": "Header", "Data": "Data", "Derived": "Data", "MetaTitle": "Other", "Notes": "Other", "Other": "Other"}
RANGES = "FileName string, SheetName string, SheetIndex string, AnnotationLabel string, FirstRow string, FirstColumn string, LastRow string, LastColumn string"


def csv_strings(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """CSV with a header, UTF-8, every column a string; .gz is read by suffix. path_file is where a row comes from."""
    schema = StructType()
    for c in columns:
        schema = schema.add(c, StringType())
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("path_file", F.col("_metadata.file_path"))


def survey_of_path(path: str = "path_file"):
    """The folder that a catalogue file is in."""
    return F.element_at(F.split(path, "/"), -2)


def table_ranges(annotations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """doc, sheet, sheet_index, the four sides of Table annotations; of the named files only, if any are."""
    rows = annotations if files is None else annotations.join(files, annotations.FileName == files.file, "left_semi")
    number = lambda c: F.trim(c).try_cast("int")
    return rows.filter(F.col("AnnotationLabel") == "Table").select(
        F.col("FileName").alias("doc"), F.col("SheetName").alias("sheet"), number("SheetIndex").alias("sheet_index"),
        number("FirstRow").alias("first_row"), number("FirstColumn").alias("first_col"), number("LastRow").alias("last_row"), number("LastColumn").alias("last_col"),
    )


def cell_roles(annotations: DataFrame) -> DataFrame:
    """doc, sheet, row, col, role of annotated ranges, cell by cell; labels without a role are ignored."""
    from ..operators.layout import expand_cells

    role = F.create_map(*(F.lit(x) for pair in ROLE_OF_LABEL.items() for x in pair))
    known = annotations.withColumn("role", role[F.col("AnnotationLabel")]).filter("role IS NOT NULL")
    number = lambda c: F.trim(c).try_cast("int")
    ranges = known.select(F.col("FileName").alias("doc"), F.col("SheetName").alias("sheet"), "role", number("FirstRow").alias("first_row"), number("FirstColumn").alias("first_col"), number("LastRow").alias("last_row"), number("LastColumn").alias("last_col"))
    return expand_cells(ranges, ["doc", "sheet", "role"])


def ragged_ranges(spark: SparkSession, path: str) -> DataFrame:
    """doc, sheet, split, folder, idx, the four sides of a ragged TSV (name, sheet, split, path, references ...).

    Rows with under five fields or without a name are skipped, blank and repeated references dropped; a
    file that stands under two paths fails the query.
    """
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter((F.size("f") >= 5) & (F.trim(F.get("f", F.lit(0))) != ""))
    rows = f.select(F.trim(F.get("f", F.lit(0))).alias("doc"), F.get("f", F.lit(1)).alias("sheet"), F.get("f", F.lit(2)).alias("split"), F.translate(F.get("f", F.lit(3)), "\\", "/").alias("folder"), F.expr("filter(transform(slice(f, 5, size(f)), x -> trim(x)), x -> x <> '')").alias("refs"))
    paths = rows.groupBy("doc").agg(F.countDistinct("folder").alias("n"))
    rows = rows.join(require(paths, F.col("n") == 1, "a file has two paths").select("doc"), "doc")
    refs = rows.select("doc", "sheet", "split", "folder", F.posexplode("refs").alias("idx", "ref")).withColumn("b", B.from_a1(F.col("ref"))).filter("b IS NOT NULL")
    return refs.groupBy("doc", "sheet", "split", "folder", "b").agg(F.min("idx").alias("idx")).select("doc", "sheet", "split", "folder", "idx", "b.*")


def corpus_index(ranges: DataFrame) -> DataFrame:
    """file, corpus (first folder), n_sheets, n_tables of ragged_ranges' rows."""
    return ranges.groupBy(F.col("doc").alias("file"), F.split_part("folder", F.lit("/"), F.lit(1)).alias("corpus")).agg(F.countDistinct("sheet").alias("n_sheets"), F.count("*").alias("n_tables"))


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object a file; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, entry (variant) of a manifest: a list under entries, a bare list, or an object of rows by name. Names get an .xlsx twin, which a name of its own beats."""
    v = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    lists = v.select(F.explode(F.coalesce(F.try_variant_get("v", "$.entries", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("entry")).select(F.try_variant_get("entry", "$.file_name", "string").alias("name"), "entry")
    keyed = v.filter(F.try_variant_get("v", "$.entries", "array<variant>").isNull() & F.try_variant_get("v", "$", "array<variant>").isNull()).select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "entry"))
    own = lists.unionByName(keyed).filter("name IS NOT NULL").withColumn("rank", F.lit(0))
    twins = own.select(F.concat(F.regexp_replace("name", r"\.[^.]+$", ""), F.lit(".xlsx")).alias("name"), "entry", F.lit(1).alias("rank"))
    return own.unionByName(twins).groupBy("name").agg(F.min_by("entry", "rank").alias("entry"))


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length, content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def latest_run(runs: DataFrame) -> DataFrame:
    """The last of run folder names (column run); those that are dates come before all others."""
    dated = F.col("run").rlike(r"^\d{4}-\d{2}-\d{2}$")
    return runs.agg(F.coalesce(F.max(F.when(dated, F.col("run"))), F.max("run")).alias("run"))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a CSV below its header, quoted line feeds considered."""
    return spark.read.option("header", True).option("multiLine", True).csv(path).count()
