"""Seeded, stratified, interleaved and ranked samples."""

from __future__ import annotations

import hashlib
from functools import reduce
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text as T
from ..sources.scratch import small, written
from . import selection

# What keeps a table from being a starter, and what makes it a flagship.
NO_STARTER = "正誤|訂正|目次|利用上|付録|凡例|調査の概要|お知らせ|取扱説明書"
FLAGSHIP = "第1表|総括|概況|全国結果|結果の概要|主要|時系列"
#: How far behind the latest date, in YYYYMM units, a table is recent; fewest surveys of a stratum's sample, and tries for it.
RECENT, MIN_SURVEYS, TRIES = 1000, 2, 20


def table_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").otherwise("4+")


def file_index(ranges: DataFrame) -> DataFrame:
    """owner, file, n_tables, n_sheets (of all labels), has_derived, bucket of files with a table. ranges: file, sheet, label."""
    index = ranges.groupBy("file").agg(F.count_if(F.col("label") == "Table").alias("n_tables"), F.countDistinct("sheet").alias("n_sheets"), F.bool_or(F.col("label") == "Derived").alias("has_derived"))
    return index.filter("n_tables > 0").select(F.substring_index("file", "__", 1).alias("owner"), "*", table_bucket(F.col("n_tables")).alias("bucket"))


def round_robin(rows: DataFrame, strata: list[str], order: list[Column], n: int, seed: int | None = None) -> DataFrame:
    """n rows, one of each stratum in turn. Strata stand in their order, or shuffled by seed (their few keys, on the driver)."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    near = ranked.filter(F.col("_r") <= n)
    if seed is None:
        turn = [F.col(s) for s in strata]
    else:
        keys = [tuple(k) for k in rows.select(*strata).distinct().orderBy(*strata).collect()]
        Random(seed).shuffle(keys)
        place = rows.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], rows.select(*strata).schema.add("_p", IntegerType()))
        near = near.join(F.broadcast(place), strata)
        turn = [F.col("_p")]
    return near.orderBy("_r", *turn).limit(n).withColumn("turn", F.col("_r")).drop("_r", "_p")


def two_picks(templates: DataFrame) -> DataFrame:
    """survey, role, template_id: of each survey a flagship and another of a different title, if there is one.

    templates: survey, template_id, stem, table_no, table_name, url, survey_date. Ties that all keys leave go by template_id.
    """
    label = F.concat_ws(" ", F.coalesce("stem", F.lit("")), F.coalesce("table_name", F.lit("")))
    pool = templates.filter((F.coalesce("url", F.lit("")) != "") & ~label.rlike(NO_STARTER)).withColumn("d", T.date_value(F.col("survey_date")))
    survey = Window.partitionBy("survey")
    pool = pool.withColumn("recent", F.col("d") >= F.max("d").over(survey) - RECENT)
    pool = pool.withColumn("n_recent", F.count_if("recent").over(survey)).filter(F.col("recent") | (F.col("n_recent") < 2))
    pool = pool.withColumn("n_stem", F.count("*").over(Window.partitionBy("survey", "stem")))
    number = T.first_number(F.coalesce(F.nullif("table_no", F.lit("")), "table_name", F.lit("")))
    order = [F.col("flag").desc(), F.col("n_stem").desc(), F.col("no"), F.col("stem"), F.col("table_name"), F.col("template_id")]
    ranked = pool.withColumn("flag", label.rlike(FLAGSHIP)).withColumn("no", number).withColumn("r", F.row_number().over(survey.orderBy(*order)))
    first = ranked.filter("r = 1").select("survey", F.col("template_id").alias("one"), F.col("stem").alias("s1"))
    rest = ranked.join(first, "survey").groupBy("survey").agg(
        F.first("one").alias("flagship"),
        F.min_by(F.when(F.col("stem") != F.col("s1"), F.col("template_id")), F.when(F.col("stem") != F.col("s1"), F.col("r"))).alias("other"),
        F.min_by(F.when(F.col("template_id") != F.col("one"), F.col("template_id")), F.when(F.col("template_id") != F.col("one"), F.col("r"))).alias("next"),
    )
    pick = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("template_id"))
    return rest.select("survey", F.inline(F.array(pick("flagship", F.col("flagship")), pick("diversity", F.coalesce("other", "next", "flagship")))))


def hash_stratified(rows: DataFrame, cell: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each cell by the SHA-256 of seed and key: native, stable under any partitioning, and the same in other engines."""
    w = Window.partitionBy(cell).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def _drawn(seed: int, cell: str, size: int, n: int, attempt: int) -> list[int]:
    """The places that Python's sample of n out of `size` ordered keys takes, seeded by the cell and the attempt: they depend on the size alone."""
    own = int(hashlib.sha256(f"{seed}:{cell}:{attempt}".encode()).hexdigest()[:16], 16)
    return Random(own).sample(range(size), min(n, size))


def seeded_stratified(rows: DataFrame, cell: str, key: str, survey: str, n: int, seed: int) -> DataFrame:
    """cell, key, attempt, status: Python's own seeded samples of each cell's keys in order, drawn again until two surveys are in.

    Keys are numbered in their cell where they are; only places are drawn, from each cell's size, so no task or driver holds a cell. A
    round draws for the cells that have no valid sample yet. Cells are a design's strata: their sizes come to the driver, a row for each.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)
    ranked = written(selection.numbered(rows.select(cell, key, survey), [cell], [key, survey]))
    sizes = {r[0]: (r.n, r.surveys) for r in ranked.groupBy(cell).agg(F.count("*").alias("n"), F.least(F.count_distinct(survey), F.lit(MIN_SURVEYS)).alias("surveys")).collect()}
    possible = [c for c, (_, surveys) in sizes.items() if surveys >= MIN_SURVEYS]
    picked, open_cells, attempt = [], {c: None for c in sizes}, 0
    while open_cells:
        last = attempt + 1 == TRIES
        places = [(c, p, i) for c in open_cells for i, p in enumerate(_drawn(seed, c, sizes[c][0], n, attempt))]
        side = spark.createDataFrame(places, f"{cell} {kind[cell]}, place long, i int")
        found = written(ranked.join(small(side), [ranked[cell].eqNullSafe(side[cell]), ranked["place"] == side["place"]]).select(ranked[cell], key, survey))
        good = {r[0] for r in found.groupBy(cell).agg(F.count_distinct(survey).alias("s")).filter(F.col("s") >= MIN_SURVEYS).select(cell).collect()}
        status = {c: ("ok", attempt) if c in good and c in possible else ("impossible", 0) if c not in possible else ("unsatisfied", TRIES) for c in open_cells}
        done = {c: v for c, v in status.items() if v[0] != "unsatisfied" or last}
        marks = spark.createDataFrame([(c, a, s) for c, (s, a) in done.items()], f"{cell} {kind[cell]}, attempt int, status string")
        picked.append(found.join(F.broadcast(marks), found[cell].eqNullSafe(marks[cell])).select(found[cell], key, "attempt", "status"))  # a row for each cell
        open_cells = {c: v for c, v in open_cells.items() if c not in done}
        attempt += 1
    return reduce(DataFrame.unionByName, picked) if picked else spark.createDataFrame([], f"{cell} {kind[cell]}, {key} {kind[key]}, attempt int, status string")


def flat_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The rows of n keys by Python's own seeded sample of the ordered keys, in order. Places are drawn from the count; the keys stay where they are."""
    ranked = written(selection.numbered(rows.select(key).distinct(), [], [key]))
    size = ranked.count()
    places = rows.sparkSession.createDataFrame([(p,) for p in Random(seed).sample(range(size), min(n, size))], "place long")
    return rows.join(small(ranked.join(small(places), "place").select(key)), key, "left_semi").orderBy(key)


def stratum_summary(pool: DataFrame, selected: DataFrame, cells: DataFrame, per_cell: int) -> DataFrame:
    """By cell of cells: the pool's size, surveys, commonest survey and its share, what was selected, fraction and shortfall."""
    by_survey = pool.groupBy("cell", "survey").agg(F.count("*").alias("n"))
    p = by_survey.groupBy("cell").agg(F.sum("n").alias("pool_n"), F.count("*").alias("pool_surveys"), F.max_by("survey", F.struct("n", -F.col("survey"))).alias("top_survey"), F.max("n").alias("top_n"))
    s = selected.groupBy("cell").agg(F.count("*").alias("n_selected"), F.countDistinct("survey").alias("selected_surveys"))
    out = cells.join(p, "cell", "left").join(s, "cell", "left").fillna(0, ["pool_n", "pool_surveys", "n_selected", "selected_surveys"])
    return out.select("cell", "pool_n", "pool_surveys", "top_survey", F.round(F.try_divide("top_n", "pool_n"), 6).alias("top_share"), "n_selected", "selected_surveys", F.round(F.try_divide("n_selected", "pool_n"), 6).alias("fraction"), (F.lit(per_cell) - F.col("n_selected")).alias("shortfall"))
