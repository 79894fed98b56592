"""File names and paths of the corpora, cells of the sampling plan, and small labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The codes of organizations with cells of their own, the name of all others, and the types of statistics.
ORGANIZATIONS = {"00200": "総務省", "00550": "経済産業省", "00450": "厚生労働省", "00500": "農林水産省", "00600": "国土交通省"}
OTHERS, NO_ORGANIZATION = "その他集約", "―"
MAIN_TYPES = ("基幹統計", "一般統計", "業務統計")
REFERENCE_TYPES = ("加工統計", "その他")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def bare_name(path: Column) -> Column:
    """The file's name without its last suffix; a leading dot starts none."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+\z", "")


def scoring_name(path: Column) -> Column:
    """The name under which a file is scored: its own if it is a workbook, else with the suffix of one."""
    return F.when(F.lower(base_name(path)).rlike(r".\.xlsx\z"), base_name(path)).otherwise(F.concat(bare_name(path), F.lit(".xlsx")))


def _slashes(folder: Column) -> Column:
    return F.replace(folder, F.lit("\\"), F.lit("/"))


def workbook_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", _slashes(folder), name)


def raw_path(folder: Column, name: Column) -> Column:
    """Where the unconverted file is: a first folder that is written twice counts once."""
    return F.concat(F.regexp_replace(_slashes(folder), r"^([^/]*)/\1(?=/|\z)", "$1"), F.lit("/"), bare_name(name), F.lit(".xls"))


def owner(name: Column) -> Column:
    return F.substring_index(name, "__", 1)


def survey_code(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def organization(code: Column) -> Column:
    """The organization of a code; all that have no cells of their own, and null, are one."""
    known = F.create_map(*(F.lit(x) for pair in ORGANIZATIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), F.lit(OTHERS))


def cell_of(stat_type: Column, code: Column) -> Column:
    """A survey's cell as (stat_type, organization); null for types outside the plan."""
    where = F.when(stat_type.isin(*MAIN_TYPES), organization(code)).when(stat_type.isin(*REFERENCE_TYPES), F.lit(NO_ORGANIZATION))
    return F.when(where.isNotNull(), F.struct(stat_type.alias("stat_type"), where.alias("organization")))


def cell_id(cell: Column) -> Column:
    return F.concat(cell["stat_type"], F.lit("×"), cell["organization"])


def cells(spark: SparkSession) -> DataFrame:
    """ord, stat_type, organization of the plan's 20 cells."""
    keys = [(t, o) for t in MAIN_TYPES for o in (*ORGANIZATIONS.values(), OTHERS)] + [(t, NO_ORGANIZATION) for t in REFERENCE_TYPES]
    return spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "ord int, stat_type string, organization string")


def severity(x: Column) -> Column:
    """As text; null stays null."""
    return x.cast("string")


def with_provenance(df: DataFrame, version: str, checker: str, mode: str, note: str, **more: str) -> DataFrame:
    """df with one struct, provenance: versions, mode, that no model was asked, a note, and whatever else is named."""
    said = {"schema_version": version, "checker_version": checker, "mode": mode, "ai": "off", "note": note} | more
    return df.withColumn("provenance", F.struct(*(F.lit(v).alias(k) for k, v in said.items())))
