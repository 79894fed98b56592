"""Header cells as sets, compared across the files of a template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

CONTAINED = 80


def header_cells(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """doc, header: the distinct trimmed values of cells (doc, sheet, row, col, value) in header rows of regions (doc, sheet, header_rows)."""
    rows = regions.select("doc", "sheet", F.explode("header_rows").alias("row")).distinct()
    return cells.join(rows, ["doc", "sheet", "row"], "left_semi").select("doc", F.trim("value").alias("header")).filter("header <> ''").distinct()


def header_sets(headers: DataFrame) -> DataFrame:
    """template, set_id, headers (ascending), n_headers, n_docs: the distinct header sets of each template's files. headers: template, doc, header."""
    sets = headers.filter("header IS NOT NULL").groupBy("template", "doc").agg(F.sort_array(F.collect_set("header")).alias("headers"))
    found = sets.groupBy("template", "headers").agg(F.count("*").alias("n_docs"))
    return found.select("template", F.substring(F.sha2(F.array_join("headers", "\x1f"), 256), 1, 16).alias("set_id"), "headers", F.size("headers").cast("long").alias("n_headers"), "n_docs")


def containments(sets: DataFrame, percent: int = CONTAINED) -> DataFrame:
    """template, set_id, other_id, shared: other sets of the template that hold at least `percent` percent of a set's headers.

    Files with equal sets are one. An inverted index leads from headers to sets; a set asks it with its rarest headers only, as many as it can't
    miss all of: a set of n that lends k of them has one of its n - k + 1 rarest. Headers that most files of a template have are thus hardly ever asked
    for. What is found is verified on the whole sets.
    """
    sets = written(sets)
    postings = sets.select("template", "set_id", F.explode("headers").alias("header"))
    known = postings.groupBy("template", "header").agg(F.count("*").alias("n_sets"))
    ranked = postings.join(known, ["template", "header"]).groupBy("template", "set_id").agg(F.sort_array(F.collect_list(F.struct("n_sets", "header"))).alias("rarest"))
    least = lambda n: F.ceil(n * percent / 100).cast("int")
    n = F.size("rarest")
    asks = ranked.select("template", "set_id", F.explode(F.slice("rarest", F.lit(1), n - least(n) + 1)).alias("x")).select("template", "set_id", "x.header")
    met = asks.join(postings.withColumnRenamed("set_id", "other_id"), ["template", "header"]).filter("set_id <> other_id").select("template", "set_id", "other_id").distinct()
    other = sets.select("template", F.col("set_id").alias("other_id"), F.col("headers").alias("others"))
    both = met.join(sets.select("template", "set_id", "headers"), ["template", "set_id"]).join(other, ["template", "other_id"])
    shared = both.withColumn("shared", F.size(F.array_intersect("headers", "others")).cast("long"))
    return shared.filter(100 * F.col("shared") >= percent * F.size("headers")).select("template", "set_id", "other_id", "shared")


def header_agreement(headers: DataFrame, percent: int = CONTAINED) -> DataFrame:
    """A row for each header set of a template: n_headers, n_docs, and how many other sets, of how many files, contain it."""
    sets = written(header_sets(headers))
    pairs = containments(sets, percent).join(sets.select("template", F.col("set_id").alias("other_id"), F.col("n_docs").alias("docs")), ["template", "other_id"])
    sums = pairs.groupBy("template", "set_id").agg(F.count("*").alias("n_containing_sets"), F.sum("docs").alias("n_containing_docs"))
    out = sets.drop("headers").join(sums, ["template", "set_id"], "left")
    return out.fillna(0, ["n_containing_sets", "n_containing_docs"])
