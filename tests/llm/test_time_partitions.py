import hashlib
import random
import zlib
from calendar import monthrange
from collections import defaultdict
from datetime import datetime, timedelta
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridmeter.llm import queries, time_partitions
from gridmeter.llm.storage import shared_folder

CUTOFF = datetime(2024, 5, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, leaf_from string"


def moment(ts, click_id):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    return datetime(ts.year, ts.month, ts.day) - timedelta(days=ts.weekday()) if k > 111 else ts


def nulls_first(x):
    return (x is not None, x)


def files_of(rows, limit):
    """(leaf, part) -> rows in order, from the top down."""
    ordered = sorted(rows, key=lambda r: (nulls_first(moment(r[1], r[0])), nulls_first(r[2]), nulls_first(r[0]), repr(r)))
    leaves = {"null": [r for r in ordered if moment(r[1], r[0]) is None]}
    timed = [(moment(r[1], r[0]), r) for r in ordered if moment(r[1], r[0]) is not None]

    def split(prefix, members, rows, depth):
        of = defaultdict(list)
        for t, r in rows:
            of[(t.year, t.month, t.day, t.hour)[depth]].append((t, r))
        runs, fits = [], False
        for m in members:
            if len(of[m]) > limit:
                fits = False
                width = [4, 2, 2, 2][depth]
                if depth == 3:
                    runs.append(([m], of[m]))
                else:
                    below = [None, range(1, 13), None, range(24)][depth + 1] or range(1, monthrange(int(prefix[:4]), m)[1] + 1)
                    split(f"{prefix}{m:0{width}d}/", below, of[m], depth + 1)
            elif fits and len(runs[-1][1]) + len(of[m]) <= limit:
                runs[-1][0].append(m)
                runs[-1][1].extend(of[m])
            else:
                runs.append(([m], list(of[m])))
                fits = True
        for run, held in runs:
            width = [4, 2, 2, 2][depth]
            leaves[f"{prefix}{run[0]:0{width}d}-{run[-1]:0{width}d}"] = [r for _, r in held]

    if timed:
        split("", range(timed[0][0].year, timed[-1][0].year + 1), timed, 0)
    return {(leaf, i // limit + 1): held[i : i + limit] for leaf, held in leaves.items() for i in range(0, len(held), limit)}


def expected(rows, parts):
    limit = 1 + len(rows) // parts
    old = [r for r in rows if r[2] is not None and r[2] < CUTOFF]
    before, after = files_of(old, limit), files_of(rows, limit)
    out = {}
    for key, held in after.items():
        stays = before.get(key) == held
        ids = ",".join("" if r[0] is None else str(r[0]) for r in held)
        out[key] = (len(held), sum(r[2] is None or r[2] >= CUTOFF for r in held), not stays, hashlib.sha256(ids.encode()).hexdigest())
    return out


def random_clicks(rng, n, late):
    rows = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(120 * 86400)) if rng.random() < 0.6 else datetime(2024, 3, 5, 7, rng.randrange(60))
        arrived = ts + timedelta(seconds=rng.randrange(3600))
        if rng.random() < late:
            arrived = CUTOFF + timedelta(seconds=rng.randrange(86400))
        rows.append((i, None if rng.random() < 0.05 else ts, arrived, rng.choice([1, None]), "x"))
    return rows + rows[: n // 10] + [(None, None, None, 7, None), (n + 5, datetime(2024, 4, 2), None, None, None)]


def check(spark, rows, parts, path=None):
    df = spark.createDataFrame(rows, CLICKS).repartition(3)
    path = path or shared_folder(spark)
    old = F.col("arrived_at") < F.lit(CUTOFF)
    got = time_partitions.rewrite(df, time_partitions.click_moments(), ["arrived_at", "click_id"], old, path, parts).collect()
    assert {(r.leaf, r.part): (r.n_rows, r.n_new, r.rewritten, r.ids_sha256) for r in got} == expected(rows, parts)
    names = [urlparse(r.path).path for r in got]
    for r, name in zip(got, names, strict=True):
        table = pq.ParquetFile(name).read()
        assert ",".join(table.column_names) == r.columns == "click_id,ts,arrived_at,client_id,leaf_from"
        ids = ",".join("" if i is None else str(i) for i in table["click_id"].to_pylist())
        assert table.num_rows == r.n_rows and hashlib.sha256(ids.encode()).hexdigest() == r.ids_sha256
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    left = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True)
    there = set()
    while left.hasNext():
        there.add(urlparse(left.next().getPath().toString()).path)
    assert {f for f in there if not f.rsplit("/", 1)[1].startswith((".", "_"))} == set(names)
    return got


@pytest.mark.parametrize(("seed", "n", "parts", "late"), [(1, 400, 20, 0.1), (2, 300, 50, 0.0), (3, 250, 9, 0.5)])
def test_brute_force(spark, seed, n, parts, late):
    got = check(spark, random_clicks(random.Random(seed), n, late), parts)
    if late == 0.1:
        assert {r.rewritten for r in got} == {True, False}


def test_an_hour_that_holds_most_rows(spark):
    rows = [(i, datetime(2024, 3, 5, 7), datetime(2024, 3, 5, 8) if i % 4 else datetime(2024, 6, 1), 1, "x") for i in range(300) if 16 <= zlib.crc32(str(i).encode()) % 128 <= 111]
    got = check(spark, rows, 10)
    assert {r.leaf for r in got} == {"2024/03/05/07-07"} and len(got) >= 10


def test_empty_siblings_join_runs(spark):
    """An empty year behind one above the limit starts a run; empty months at the end of a year belong to its last run."""
    limit = 4
    hours = [(y, 1, 1, 0, n) for y, n in ((2003, 5), (2005, 2), (2006, 3), (2009, 1))]
    schema = "y long, m long, d long, h long, n long"
    rows = spark.createDataFrame(hours, schema).withColumn("layout", F.lit(1))
    kept = time_partitions.surviving_siblings(rows, limit)
    found = kept.groupBy("layout", "depth", "y", "m", "d").applyInPandas(time_partitions._fit(limit), time_partitions._RUN)
    names = {r.leaf for r in found.select(time_partitions.leaf_name(F.col("leaf_from"), F.col("leaf_to")).alias("leaf")).collect()}
    assert names == {"2004-2005", "2006-2009", "2003/01/01/00-00"}


def test_no_rows_no_old_rows(spark):
    empty = spark.createDataFrame([], CLICKS)
    assert time_partitions.rewritten_clicks(empty, "2024-05-01 00:00:00").count() == 0
    late = [(i, datetime(2024, 5, 2, i), datetime(2024, 5, 3), None, None) for i in range(20)]
    assert all(r.rewritten and r.n_new == r.n_rows for r in check(spark, late, 5))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/clicks.parquet").collect()]
    got = queries.op12_time_partitions(spark, sf).collect()
    assert {(r.leaf, r.part): (r.n_rows, r.n_new, r.rewritten, r.ids_sha256) for r in got} == expected(rows, 500)
