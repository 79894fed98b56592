"""Files by adaptive stretches of time: years where rows are few, hours where they are many, each within a size.

Hours are counted first, and complete sets of siblings (the hours of a day, the days of a month, the months of a year)
collapse into their parent, level by level, where the parent holds no more than `limit` rows. What survives is, at each
level, the children of parents above the limit. In time order each such sibling within the limit joins the run of the
one before it while the run stays within the limit, else starts one (next-fit); empty siblings take part. Leaves are the runs
with rows, single hours above the limit, and the rows without a moment. A leaf's rows, by moment and further columns,
fill parts of `limit` rows, a Parquet file each.

`Layout` says for two states of a table, the rows marked old and all rows, where each row belongs. The first is written,
then the folder is rewritten for the second: files whose leaf, part and rows recur stay as they are, the others are
written anew before those that go are deleted.

The rows themselves are moved once for each file written. Leaves come to them by four lookups in a table of siblings,
which a `limit` of a 500th of the rows bounds whatever the input (500 parents a level, 31 children each, and the years);
a larger table is joined without broadcast. Only leaves above the limit need ranks: their rows are dealt by ranges of the sort
order, numbered in each range, and the ranges' totals are added up, so that no task holds a leaf. Rows are told apart
by a hash of all columns after the order's own, so that equal rows may stand in any order.

Defined results: rows without a moment form the leaf `null`; nulls in the other sort columns come first; rows whose
mark is null are not old; repeated rows all count; no rows give no files. Columns of any name may ride along.
"""

from __future__ import annotations

import calendar
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, materialize, partitions, shared_folder, ship

#: A leaf, or one of its rows' nodes, as one number: yyyymmddhh with hours from 1, and zeros below its level.
_FIELDS = ("y", "m", "d", "h")
_KEY = ("leaf_from", "leaf_to", "leaf_part")
_RUN = "layout int, node long, leaf_from long, leaf_to long, above boolean"
_OLD, _ALL = 1, 2
MANIFEST = "leaf string, part long, n_rows long, n_new long, rewritten boolean, columns string, ids_sha256 string, path string"


def click_moments(ts: str = "ts", click_id: str = "click_id") -> Column:
    """A click's moment: some are moved back by years, some floored to their week's Monday, by a hash of the id."""
    at = F.col(ts).cast("timestamp_ntz")
    k = F.pmod(F.crc32(F.col(click_id).cast("string")), F.lit(128)).cast("int")
    back = at - F.make_dt_interval((k + 6) * (k + 6) * (k + 6))
    day = at.cast("date")
    monday = F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")
    return F.when(k < 16, back).when(k > 111, monday).otherwise(at)


def _node(depth: int, *fields: Column | int) -> Column | int:
    """The number of a node of a depth (1 years, 4 hours) from its fields."""
    y, m, d, h = (*fields[:depth], *(0,) * (4 - depth))
    return ((y * 100 + m) * 100 + d) * 100 + (h + 1 if depth == 4 else h)


def _fit(limit: int):
    """Runs of one set of siblings: for each with rows and no leaves below it, the first and last member of its run."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        layout, depth, *above = (int(k) for k in key)
        above = above[: depth - 1]
        n = dict(zip(rows["member"].astype(int), rows["n"].astype(int), strict=True))
        members = {1: lambda: range(min(n), max(n) + 1), 2: lambda: range(1, 13), 3: lambda: range(1, calendar.monthrange(2000 + above[0] % 400, above[1])[1] + 1), 4: lambda: range(24)}[depth]()
        runs, size = [], None
        for x in members:
            if n.get(x, 0) > limit:
                size = None
                if depth == 4:
                    runs.append([x])
            elif size is not None and size + n.get(x, 0) <= limit:
                runs[-1].append(x)
                size += n.get(x, 0)
            else:
                runs.append([x])
                size = n.get(x, 0)
        code = lambda x: _node(depth, *above, x)
        out = [(layout, code(x), code(r[0]), code(r[-1]), n[x] > limit) for r in runs for x in r if n.get(x)]
        return pd.DataFrame(out, columns=["layout", "node", "leaf_from", "leaf_to", "above"])

    return run


def surviving_siblings(hours: DataFrame, limit: int) -> DataFrame:
    """layout, depth, y, m, d (the parent's fields, else 0), member, n: the siblings that no parent within the limit has taken.

    hours: layout, y, m, d, h, n.
    """
    level, out = hours, []
    for depth in (4, 3, 2):
        parent = ["layout", *_FIELDS[: depth - 1]]
        whole = level.withColumn("whole", F.sum("n").over(Window.partitionBy(*parent)))  # 31 children at most
        out.append(_siblings(whole.filter(F.col("whole") > limit), depth))
        level = level.groupBy(*parent).agg(F.sum("n").alias("n"))
    out.append(_siblings(level, 1))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both


def _siblings(level: DataFrame, depth: int) -> DataFrame:
    return level.select("layout", F.lit(depth).alias("depth"), *((F.col(f) if i < depth - 1 else F.lit(0)).alias(f) for i, f in enumerate(_FIELDS[:3])), F.col(_FIELDS[depth - 1]).alias("member"), "n")


def leaf_name(first: Column, last: Column) -> Column:
    part = lambda c, i: (F.floor(c / 100**i) % 100 if i < 3 else F.floor(c / 100**3)).cast("long")
    y, m, d, h = (part(first, i) for i in (3, 2, 1, 0))
    by_year = F.format_string("%04d-%04d", y, part(last, 3))
    by_month = F.format_string("%04d/%02d-%02d", y, m, part(last, 2))
    by_day = F.format_string("%04d/%02d/%02d-%02d", y, m, d, part(last, 1))
    by_hour = F.format_string("%04d/%02d/%02d/%02d-%02d", y, m, d, h - 1, part(last, 0) - 1)
    return F.when(first == 0, "null").when(m == 0, by_year).when(d == 0, by_month).when(h == 0, by_day).otherwise(by_hour)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Layout:
    """Where the rows of a table belong, for those marked old and for all."""

    def __init__(self, rows: DataFrame, moment: Column, order: list[str], old: Column, parts: int = 500, limit: int | None = None):
        self.spark, self.columns, self.order = rows.sparkSession, rows.columns, order
        ship(self.spark)
        work = rows.select(moment.alias("t"), F.coalesce(old, F.lit(False)).alias("old"), F.struct("*").alias("r"))
        fields = {f: g("t").cast("long") for f, g in zip(_FIELDS, (F.year, F.month, F.dayofmonth, F.hour), strict=True)}
        self.work = work.withColumns(fields)
        hours = materialize(self.work.groupBy(*_FIELDS).agg(F.count_if("old").alias("n1"), F.count("*").alias("n2")))
        self.n_old, self.n_all = (int(x or 0) for x in hours.agg(F.sum("n1"), F.sum("n2")).first())
        self.limit = limit or 1 + self.n_all // parts
        self.assigned = self._assigned(self._leaves(hours)) if self.n_all else None

    def _leaves(self, hours: DataFrame) -> DataFrame:
        """node, and for each layout the leaf that its rows belong to and whether that is above the limit."""
        both = hours.select(*_FIELDS, F.inline(F.array(*(F.struct(F.lit(i).alias("layout"), F.col(f"n{i}").alias("n")) for i in (_OLD, _ALL))))).filter("n > 0")
        siblings = surviving_siblings(both.filter("y IS NOT NULL"), self.limit)
        found = siblings.groupBy("layout", "depth", "y", "m", "d").applyInPandas(_fit(self.limit), _RUN)
        none = both.filter("y IS NULL").select("layout", *(F.lit(0).cast("long").alias(c) for c in ("node", "leaf_from", "leaf_to")), (F.col("n") > self.limit).alias("above"))
        of = lambda i: F.max(F.when(F.col("layout") == i, F.struct("leaf_from", "leaf_to", "above"))).alias(f"leaf{i}")
        return materialize(found.unionByName(none).groupBy("node").agg(of(_OLD), of(_ALL)))

    def _assigned(self, leaves: DataFrame) -> DataFrame:
        """r, t, old, tie and leaf_from, leaf_to, leaf_part of both layouts (with 1 or 2 at the end)."""
        rows = self.work.withColumns({f"node{depth}": F.coalesce(_node(depth, *map(F.col, _FIELDS)), F.lit(0)) for depth in (1, 2, 3, 4)})
        table = _small(leaves)
        for depth in (1, 2, 3, 4):
            rows = rows.join(table.select(F.col("node").alias(f"node{depth}"), *(F.col(f"leaf{i}").alias(f"at{depth}_{i}") for i in (_OLD, _ALL))), f"node{depth}", "left")
        leaf = lambda i: F.coalesce(*(F.col(f"at{depth}_{i}") for depth in (1, 2, 3, 4)))
        rows = rows.select("r", "t", "old", F.xxhash64("r").alias("tie"), F.when(F.col("old"), leaf(_OLD)).alias("leaf1"), leaf(_ALL).alias("leaf2"))
        one = F.lit(1).cast("long")
        few = rows.filter(~F.col("leaf2.above")).withColumns({"part1": F.when(F.col("old"), one), "part2": one})
        both = few.unionByName(self._ranked(rows.filter("leaf2.above")))
        return both.select("r", "t", "old", "tie", *(F.col(f"leaf{i}.{k}").alias(f"{k}{i}") for i in (_OLD, _ALL) for k in _KEY[:2]), F.col("part1").alias("leaf_part1"), F.col("part2").alias("leaf_part2"))

    def _sort(self) -> list[Column]:
        return [F.col("t"), *(F.col(f"r.{c}") for c in self.order), F.col("tie")]

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """The parts of rows in leaves above the limit: ranks in ranges of the sort order, and the ranges' totals before them."""
        number = F.monotonically_increasing_id()
        dealt = rows.repartitionByRange(partitions(self.spark), *self._sort()).sortWithinPartitions(*self._sort())
        dealt = materialize(dealt.withColumns({"range": F.shiftright(number, 33), "seq": number, "of": F.col("leaf2.leaf_from")}))
        here = Window.partitionBy("range", "of").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # a range's rows at most
        local = dealt.withColumns({"before1": F.coalesce(F.sum(F.col("old").cast("long")).over(here), F.lit(0)), "before2": F.coalesce(F.sum(F.lit(1)).over(here), F.lit(0))})
        totals = dealt.groupBy("range", "of").agg(F.count_if("old").alias("n1"), F.count("*").alias("n2"))
        ahead = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        totals = totals.select("range", "of", *(F.coalesce(F.sum(f"n{i}").over(ahead), F.lit(0)).alias(f"ahead{i}") for i in (1, 2)))
        ranks = local.join(_small(materialize(totals)), ["range", "of"])
        part = lambda i: F.floor((F.col(f"before{i}") + F.col(f"ahead{i}")) / self.limit).cast("long") + 1
        # an hour may be above the limit among all rows only; then its old rows are one part
        parts = {"part1": F.when(F.col("old"), F.when(F.col("leaf1.above"), part(1)).otherwise(1)), "part2": part(2)}
        return ranks.withColumns(parts).select("r", "t", "old", "tie", "leaf1", "leaf2", "part1", "part2")

    def plan(self) -> DataFrame:
        """A row for each file of all rows: its leaf and part, n_rows, n_new, and whether the same rows were a file of the old ones."""
        key = lambda i: [F.col(f"{k}{i}").alias(k) for k in _KEY]
        same = F.coalesce(F.struct(*key(1)) == F.struct(*key(2)), F.lit(False)) & F.col("old")
        files = self.assigned.groupBy(*key(2)).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("old")).alias("n_new"), F.count_if(same).alias("n_same"))
        before = self.assigned.filter("old").groupBy(*key(1)).agg(F.count("*").alias("n_before"))
        stays = (F.col("n_same") == F.col("n_rows")) & (F.col("n_before") == F.col("n_rows"))
        return materialize(files.join(before, list(_KEY), "left").select(*_KEY, "n_rows", "n_new", F.coalesce(stays, F.lit(False)).alias("stays")))

    def folders(self) -> list[str]:
        """The names of the partition folders, which no column of the table has."""
        tail = ""
        while any(f"{k}{tail}".lower() in {c.lower() for c in self.columns} for k in _KEY):
            tail += "_"
        return [f"{k}{tail}" for k in _KEY]

    def write(self, rows: DataFrame, layout: int, path: str) -> None:
        """A file for each leaf and part of the assigned rows, each by one task, as they stream."""
        names = self.folders()
        keys = [f"{k}{layout}" for k in _KEY]
        dealt = rows.repartition(partitions(self.spark), *keys).sortWithinPartitions(*keys, *self._sort())
        out = dealt.select("r.*", *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
        out.write.mode("append").option("maxRecordsPerFile", 0).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(*names).parquet(path)

    def files(self, path: str) -> DataFrame:
        """leaf_from, leaf_to, leaf_part, path, at (row in its file) and id of all rows under path."""
        schema = self.assigned.select("r.*").schema
        for n in self.folders():
            schema = schema.add(n, "long")
        return self.spark.read.schema(schema).parquet(path).select(*(F.col(n).alias(k) for n, k in zip(self.folders(), _KEY, strict=True)), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(self.order[-1]).cast("string").alias("id"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files come one after another, their rows in order: a digest of the ids of each."""
    path, key, n, digest = None, None, 0, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_KEY, key, strict=True)) | {"path": path, "n": n, "ids_sha256": digest.hexdigest()}])

    for batch in batches:
        paths = batch["path"].to_pylist()
        cuts = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if paths[a] != path:
                if path is not None:
                    yield done()
                path, key, n, digest = paths[a], [batch[k][a].as_py() for k in _KEY], 0, hashlib.sha256()
            ids = batch["id"].slice(a, b - a).fill_null("").to_pylist()
            digest.update(("," if n else "").encode() + ",".join(ids).encode())
            n += b - a
    if path is not None:
        yield done()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(p))
        file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, False)


def rewrite(rows: DataFrame, moment: Column, order: list[str], old: Column, path: str, parts: int = 500, limit: int | None = None) -> DataFrame:
    """Writes the old rows to a new folder, rewrites it for all rows, and returns a row for each final file (see MANIFEST).

    order: the columns that sort rows after the moment; the last one is the id of which files get digests.
    limit: rows of a file at most; else 1 + rows // parts. The names of the files that go pass through the driver, one for each `limit` rows.
    """
    spark = rows.sparkSession
    layout = Layout(rows, moment, order, old, parts, limit)
    if not layout.n_all:
        return spark.createDataFrame([], MANIFEST)
    plan = layout.plan()
    if layout.n_old:
        layout.write(layout.assigned.filter("old"), _OLD, path)
        started = materialize(layout.files(path).select(*_KEY, "path").distinct())
        gone = [r.path for r in started.join(plan.filter("stays"), list(_KEY), "left_anti").select("path").toLocalIterator()]
    else:
        gone = []
    changed = plan.filter(~F.col("stays")).select(*(F.col(k).alias(f"{k}2") for k in _KEY))
    if changed.count():
        layout.write(layout.assigned.join(_small(changed), [f"{k}2" for k in _KEY]), _ALL, path)
    _delete(spark, gone)
    found = layout.files(path).repartition(partitions(spark), "path").sortWithinPartitions("path", "at")
    found = found.mapInArrow(_digests, "leaf_from long, leaf_to long, leaf_part long, path string, n long, ids_sha256 string")
    return found.join(plan, list(_KEY)).select(
        leaf_name(F.col("leaf_from"), F.col("leaf_to")).alias("leaf"), F.col("leaf_part").alias("part"), F.col("n").alias("n_rows"), "n_new",
        (~F.col("stays")).alias("rewritten"), F.lit(",".join(layout.columns)).alias("columns"), "ids_sha256", "path",
    )


def rewritten_clicks(clicks: DataFrame, cutoff: str, parts: int = 500) -> DataFrame:
    """rewrite() of clicks in a new shared folder; those that arrived before cutoff are old."""
    old = F.col("arrived_at").cast("timestamp_ntz") < F.lit(cutoff).cast("timestamp_ntz")
    return rewrite(clicks, click_moments(), ["arrived_at", "click_id"], old, shared_folder(clicks.sparkSession), parts)
