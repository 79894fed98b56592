"""Catalogues of files: flattening, formats, template keys, de-duplication.

resources: survey, title, stem, stem_region, table_no, table_name, survey_date, format, url, resource_id, organization, released, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FORMATS = ("XLS", "XLS_REP")
#: Table numbers count as periods in disguise where so many of a title's rows have numbers of their own.
MIN_ENCODED = 0.9


def kept_formats(resources: DataFrame) -> DataFrame:
    return resources.filter(F.upper(F.trim("format")).isin(*FORMATS))


def dropped_formats(resources: DataFrame) -> DataFrame:
    """format, n of the rows that kept_formats leaves out; blanks as (empty)."""
    name = F.upper(F.trim(F.coalesce("format", F.lit(""))))
    return resources.filter(~name.isin(*FORMATS)).groupBy(F.when(name == "", "(empty)").otherwise(name).alias("format")).agg(F.count("*").alias("n"))


def with_stems(resources: DataFrame) -> DataFrame:
    """stem, stem_region and normal names from titles."""
    return resources.withColumns({"stem": T.title_stem("title"), "stem_region": T.title_stem_with_region("title"), "table_no": T.normal_name("table_no"), "table_name": T.normal_name("table_name")})


def period_encoded(resources: DataFrame) -> DataFrame:
    """survey, stem of titles whose table numbers encode periods: several rows and dates, nearly all numbers distinct, fewer names than numbers."""
    known = resources.filter(F.coalesce("table_no", F.lit("")) != "")
    sizes = known.groupBy("survey", "stem").agg(F.count("*").alias("n"), F.countDistinct("survey_date").alias("dates"), F.countDistinct("table_no").alias("nos"), F.countDistinct("table_name").alias("names"))
    return sizes.filter((F.col("n") >= 2) & (F.col("dates") > 1) & (F.col("nos") >= MIN_ENCODED * F.col("n")) & (F.col("names") < F.col("nos")))


def template_keys(resources: DataFrame, encoded: DataFrame) -> DataFrame:
    """resources with key_kind, key_value, key_source: the table number, or the name where there is no number or it encodes periods."""
    marked = resources.join(encoded.select("survey", "stem", F.lit(True).alias("encoded")), ["survey", "stem"], "left")
    by_name, none = F.coalesce("encoded", F.lit(False)), F.coalesce("table_no", F.lit("")) == ""
    pick = lambda a, b, c: F.when(by_name, a).when(none, b).otherwise(c)
    return marked.withColumns({
        "key_kind": pick(F.lit("name"), F.lit("name"), F.lit("no")), "key_value": pick(F.col("table_name"), F.col("table_name"), F.col("table_no")),
        "key_source": pick(F.lit("table_name:no_period_encoded"), F.lit("table_name:no_missing"), F.lit("table_no")),
    }).drop("encoded")


def modal(value: str, keys: list[str], rows: DataFrame, ord_: str = "ord") -> DataFrame:
    """keys, value: the commonest value of each key, the first seen of equally common ones."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(ord_).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def templates(resources: DataFrame) -> DataFrame:
    """One row for each template: its id, counts and representative (the latest; ties by release, id, and then the first seen)."""
    keyed = template_keys(resources, period_encoded(resources)).withColumn("date_key", T.date_key(F.col("survey_date")))
    keys = ["survey", "stem", "key_kind", "key_value"]
    best = F.struct("date_key", "released", "resource_id", -F.col("ord"))
    fields = F.struct("resource_id", "url", "survey_date", "table_no", "table_name", "key_source")
    out = keyed.groupBy(*keys).agg(
        F.count("*").alias("n_instances"), F.countDistinct("survey_date").alias("n_dates"), F.countDistinct("stem_region").alias("n_regions"),
        F.array_join(F.array_sort(F.collect_set(F.upper(F.trim("format")))), "+").alias("formats"), F.max_by(fields, best).alias("r"),
    )
    org = modal("organization", keys, keyed)
    return out.join(org, keys).select(T.digest_id(*map(F.col, keys)).alias("template_id"), *keys, "n_instances", "n_dates", "n_regions", "formats", "organization", "r.*")


def template_summary(resources: DataFrame, found: DataFrame) -> DataFrame:
    """By survey: rows, templates, rows for each template, templates keyed by name, and those with several regions."""
    rows = resources.groupBy("survey").agg(F.count("*").alias("n_rows"))
    t = found.groupBy("survey").agg(F.count("*").alias("n_templates"), F.count_if(F.col("key_kind") == "name").alias("n_by_name"), F.count_if(F.col("n_regions") > 1).alias("n_multi_region"))
    return rows.join(t, "survey").withColumn("redundancy", F.round(F.try_divide("n_rows", "n_templates"), 1))


def frame(rows: DataFrame) -> DataFrame:
    """The survey frame: rows with a code, the last of each code, circles as booleans. rows: gov_stats_code, ..., has_file, has_db, ord."""
    from .rules import last_per_key

    circle = lambda c: F.trim(c).isin("〇", "○", "◯")
    known = rows.withColumn("gov_stats_code", T.strip(F.col("gov_stats_code"))).filter("gov_stats_code <> ''")
    return last_per_key(known, ["gov_stats_code"], "ord").withColumns({"has_file": circle("has_file"), "has_db": circle("has_db")})


def population(frame_rows: DataFrame) -> DataFrame:
    return frame_rows.filter("has_file")


def with_frame(resources: DataFrame, frame_rows: DataFrame) -> DataFrame:
    """resources with the frame's name and type, blank where the frame has no row. The frame has a row for each survey of a country: small."""
    side = frame_rows.select(F.col("gov_stats_code").alias("survey"), "gov_stats_name", "stats_type")
    return resources.join(side, "survey", "left").fillna("", ["gov_stats_name", "stats_type"])


def stats_type(x: Column, known: tuple[str, ...]) -> Column:
    """The known type that equals x, else the first that x contains, else blank."""
    out = F.when(x.isin(*known), x)
    for k in known:
        out = out.when(F.contains(x, F.lit(k)), k)
    return out.otherwise("")


def flatten_pages(raw: DataFrame) -> DataFrame:
    """stat, number, dataset of raw JSON (column json): an optional pages wrapper, and one or many datasets, as arrays."""
    v = raw.select("stat", F.parse_json("json").alias("v"))
    pages = v.select("stat", F.explode(F.coalesce(F.try_variant_get("v", "$.pages", "array<variant>"), F.array("v"))).alias("p"))
    info = "$.GET_DATA_CATALOG.DATA_CATALOG_LIST_INF"
    number = F.try_variant_get("p", f"{info}.NUMBER", "string")
    many = F.try_variant_get("p", f"{info}.DATA_CATALOG_INF", "array<variant>")
    one = F.array(F.try_variant_get("p", f"{info}.DATA_CATALOG_INF", "variant"))
    rows = pages.select("stat", F.when(number.rlike("^[0-9]+$"), number.cast("long")).alias("number"), F.explode(F.coalesce(many, one)).alias("d"))
    get = lambda path: F.try_variant_get("d", path, "string")
    return rows.filter("d IS NOT NULL").select("stat", "number", get("$.DATASET.ORGANIZATION['@code']").alias("organization_code"), get("$.DATASET.ORGANIZATION['$']").alias("organization_name"))


def fetch_status(log: DataFrame) -> DataFrame:
    """status of each row of a fetch log (error, number, n_datasets): error, ok or incomplete."""
    return log.withColumn("status", F.when(F.coalesce("error", F.lit("")) != "", "error").when(F.col("number") == F.col("n_datasets"), "ok").otherwise("incomplete"))


def unfinished(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items to work on: those without a finished row; failed ones come again."""
    return items.join(done.filter(F.coalesce("status", F.lit("")) != "error"), key, "left_anti")
