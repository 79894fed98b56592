"""Keyed tables, the cache and the stream that resumes: what is read, what stays, and two writers at once."""

import pytest
from pyspark.sql import functions as F

from gridmeter.sources.keyed import BUCKET, KeyedTable, cached
from gridmeter.streaming import incremental

ROWS = "k string, v int"


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_adding_twice(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], 8)
    assert table.read() is None and table.version() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), (None, 5)], ROWS)
    assert table.add_missing(rows) == 1 and content(table.read()) == [("a", 1), ("b", 2), (None, 5)]
    assert table.add_missing(rows) == 1
    more = spark.createDataFrame([("a", 9), ("c", 3)], ROWS)
    assert table.add_missing(more) == 2 and content(table.read()) == [("a", 1), ("b", 2), ("c", 3), (None, 5)]
    assert content(table.read(1)) == [("a", 1), ("b", 2), (None, 5)]
    assert KeyedTable(spark, f"file://{tmp_path}/t", ["k"], 99).buckets == 8
    assert table.add_missing(rows.limit(0)) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second one's rows are written once, and keys that the first has published meanwhile are left out."""
    table, other = (KeyedTable(spark, f"file://{tmp_path}/t", ["k"], 4) for _ in range(2))
    publish, computed = KeyedTable._publish, spark.sparkContext.accumulator(0)

    def late(self, version, manifest):
        if self is table and not other.version():
            other.add_missing(spark.createDataFrame([("a", 100), ("x", 7)], ROWS))
        return publish(self, version, manifest)

    monkeypatch.setattr(KeyedTable, "_publish", late)

    def counted(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("a", 1), ("b", 2)], ROWS).coalesce(1).mapInArrow(counted, ROWS)
    assert table.add_missing(rows) == 2
    assert content(table.read()) == [("a", 100), ("b", 2), ("x", 7)] and computed.value == 2
    assert not publish(table, 2, {})


def test_a_batch_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    table = KeyedTable(spark, path, ["k"], 32)
    table.add_missing(spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v")))
    read, files = KeyedTable.read, []

    def watched(self, *args, **kwargs):
        out = read(self, *args, **kwargs)
        files.extend(out.inputFiles())
        return out

    monkeypatch.setattr(KeyedTable, "read", watched)
    few = spark.createDataFrame([("7", 0), ("new", 1)], ROWS)
    table.add_missing(few)
    own = {f"{BUCKET}={b}" for b in table.touched(few)}
    assert files and {part for f in files for part in f.split("/") if part.startswith(BUCKET)} <= own and len(own) <= 2


def test_a_stream_resumes(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    for turn in range(2):  # another checkpoint: every file comes again
        incremental.append_new(incremental.stream(spark, f"{tmp_path}/in", rows.schema, 1), f"{tmp_path}/out", "k", f"{tmp_path}/check{turn}", 8).awaitTermination()
        table = KeyedTable(spark, f"{tmp_path}/out", ["k"])
        assert content(table.read()) == content(rows)
    assert table.version() <= 3


def test_windowed_rates(spark, tmp_path):
    schema = "t timestamp, rule_id string, passed boolean, skipped boolean"
    for i, rows in enumerate((["2024-01-01 00:01:00", "2024-01-01 00:02:00"], ["2024-01-01 03:00:00"], ["2024-01-01 00:03:00", "2024-01-01 06:00:00"])):
        spark.createDataFrame([(t, "r", i == 0, False) for t in rows], "t string, rule_id string, passed boolean, skipped boolean").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = incremental.windowed_rates(source, "t", "1 hour", "30 minutes").writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.window.start.hour: (r.n, r.n_pass) for r in spark.table("windowed").collect()}
    assert got[0][0] in (2, 3) and got[0][1] == 2 and got[3] == (1, 0)  # the late row counts only if its file came first


def test_the_cache(spark, tmp_path):
    path, runs = f"file://{tmp_path}/c", spark.sparkContext.accumulator(0)

    def compute(df, factor=2):
        def work(batches):
            for b in batches:
                runs.add(b.num_rows)
                yield b

        return df.mapInArrow(work, df.schema).withColumn("x", F.col("v") * factor).withColumn("parts", F.array("v", F.lit(None).cast("int")))

    files = spark.createDataFrame([("h1", 1), ("h2", 2), ("h1", 1), (None, 3)], ROWS)
    first = cached(files, compute, path, ["k"], code="1.0", mode="standard")
    assert content(first.select("k", "x")) == [("h1", 2), ("h2", 4), (None, 6)] and runs.value == 3
    assert content(cached(files, compute, path, ["k"], code="1.0", mode="standard")) == content(first) and runs.value == 3
    assert first.filter("k = 'h1'").first().parts == [1, None]
    assert cached(files, lambda d: compute(d, 5), path, ["k"], code="1.1", mode="standard").filter("k = 'h2'").first().x == 10 and runs.value == 6
    assert cached(files, compute, path, ["k"], code="1.0", mode="fast").count() == 3 and runs.value == 9
    assert cached(files, lambda d: compute(d).drop("parts"), path, ["k"], code="1.0", mode="standard").columns == ["k", "v", "x"] and runs.value == 12
    assert cached(files.limit(0), compute, path, ["k"], code="9").count() == 0


@pytest.mark.parametrize("taken", [False, True])
def test_write_back(spark, tmp_path, monkeypatch, taken):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], 16)
    table.add_missing(spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"), F.lit("x").alias("label")))
    before = set(table.read().inputFiles())
    if taken:
        publish = KeyedTable._publish

        def late(self, version, manifest):
            monkeypatch.setattr(KeyedTable, "_publish", publish)
            KeyedTable(spark, self.path, ["k"]).add_missing(spark.createDataFrame([("new", 1, "y")], "k string, v int, label string"))
            return publish(self, version, manifest)

        monkeypatch.setattr(KeyedTable, "_publish", late)
    new = spark.createDataFrame([("5", 9, "z"), ("6", None, "w"), ("absent", 1, "q")], "k string, v int, label string")
    version = table.write_back(new, ["v", "label"])
    assert version == 2 + taken
    got = {r.k: (r.v, r.label) for r in table.read().collect()}
    assert got["5"] == (9, "z") and got["6"] == (0, "w") and got["7"] == (0, "x") and len(got) == 100 + taken
    touched = {f"{BUCKET}={b}" for b in table.touched(new)}
    after = set(table.read().inputFiles())
    assert {f for f in before if f.split("/")[-2] not in touched} <= after and not {f for f in before if f.split("/")[-2] in touched} & after
    assert {r.v for r in table.read(1).collect()} == {0}
