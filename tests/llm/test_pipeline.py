import random

import pyarrow.parquet as pq

import corpus_pipeline
import __spark_entry__


def test_stages_take_effect(spark, make_docs, vocabulary, tmp_path):
    rng = random.Random(12)
    text = lambda k=60: " ".join(rng.choices(vocabulary, k=k))
    docs = [(i, text(), "en", f"s{i % 3}") for i in range(90)]
    toxic = [(100 + i, text() + " vilest " + text(5), "en", "s0") for i in range(40)]
    leak = text(20)
    docs += toxic + [(200, text() + " " + leak, "en", "s1"), (201, docs[5][1], "en", "s1"), (202, docs[5][1] + " more", "en", "s2"), (203, "", "en", "s0"), (None, text(), "en", None)]
    make_docs(docs).drop("node", "part").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(140) if i < 90 or i >= 100], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, table = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == rows.columns, name
        out.write.parquet(f"{tmp_path}/{i}.parquet")
        rows = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        table.append([r.doc_id for r in rows.select("doc_id").collect()])
    toxicity, join, leaks, mix, shards = table
    assert not set(toxicity) & set(range(100, 140)) and set(range(90)) | {200, 201, 202, 203, None} <= set(toxicity)
    assert set(toxicity) - set(join) == {201, 202} and len(join) == len(toxicity) - 2
    assert set(join) - set(leaks) == {200}
    assert set(mix) <= set(leaks) and 203 not in mix and max(map(mix.count, mix)) <= 2
    assert sorted(map(str, shards)) == sorted(map(str, mix))
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()


def test_near_duplicates_one_word_longer(spark, make_docs):
    """Four of five shingles in common: 80 %."""
    text = "one two three four five six seven eight nine"
    docs = make_docs([text.rsplit(" ", 1)[0], text, "nothing else here has any of those words at all"])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_rows_that_repeat_a_doc_id(spark, make_docs):
    """An exact copy goes, whatever it shares its id with."""
    a, z = "one text of quite a few words that stand here", "and another one with nothing at all in common"
    docs = make_docs([(3, a, "en", "s"), (5, a, "en", "s"), (5, z, "en", "s")])
    rows = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(3, a), (5, z)]


def test_rows_without_doc_id_keep_their_sources_shares(spark, make_docs):
    """Sources a and b, weights 3 and 1: 2 times a, and what is left of b."""
    docs = [(None, f"{s} {i} " + "w " * 18, "en", s) for s, n in (("a", 4), ("b", 40)) for i in range(n)]
    got = [r.source for r in corpus_pipeline.source_mix(spark, make_docs(docs), "").collect()]
    assert got.count("a") == 8 and got.count("b") == 58


def test_the_mix_comes_in_the_order_of_its_slots(spark, make_docs):
    docs = [(i, "w " * 1024, "en", "ab"[i % 2]) for i in range(60)]
    got = [r.source for r in corpus_pipeline.source_mix(spark, make_docs(docs), "").collect()]
    assert len(got) == 90 and all(abs(got[:n].count("a") / n - got.count("a") / 90) < 0.12 for n in (30, 45, 60))


def test_the_shards_carry_the_slots_of_the_mix(spark, make_docs, tmp_path):
    docs = [(i, "w " * (900 + i), "en", "abc"[i % 3]) for i in range(90)]
    mixed = corpus_pipeline.source_mix(spark, make_docs(docs), "").select(*corpus_pipeline.COLUMNS)
    mixed.write.parquet(f"{tmp_path}/mixed.parquet")
    files = sorted(tmp_path.glob("mixed.parquet/part-*.parquet"))
    order = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]
    out = corpus_pipeline.shards(spark, spark.read.parquet(f"{tmp_path}/mixed.parquet"), "").orderBy("slot").collect()
    assert len(files) > 1 and [r.slot for r in out] == list(range(len(order))) and [r.doc_id for r in out] == order
    own = corpus_pipeline.shards(spark, make_docs(["x", "y", "z"]), "").orderBy("slot").collect()
    assert [r.text for r in own] == ["x", "y", "z"]


def test_empty_tables_pass_every_stage(spark, make_docs, tmp_path):
    make_docs(["x"]).limit(0).drop("node", "part").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_start_few_jobs(spark, make_docs, vocabulary, tmp_path):
    """The driver's memory follows jobs and plans: steps that gain nothing from another plan are no job for each shuffle."""
    rng = random.Random(3)
    text = lambda k=60: " ".join(rng.choices(vocabulary, k=k))
    docs = [(i, text(), "en", f"s{i % 3}") for i in range(60)]
    leak = text(20)
    docs += [(100, docs[5][1] + " more", "en", "s2"), (101, docs[7][1], "en", "s1"), (102, text() + " " + leak, "en", "s1")]
    make_docs(docs).drop("node", "part").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, jobs = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    for name, stage in corpus_pipeline.STAGES:
        group = f"{tmp_path}/{name}"
        spark.sparkContext.setJobGroup(group, name)
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}.parquet")
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        rows = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(jobs.values()) <= 165, jobs
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_shards_and_tiers_are_of_one_manifest(spark, make_docs, tmp_path):
    """A commit between two reads of the manifest would leave rows without their tier."""
    from gridmeter.llm import sharding

    store = sharding.shard(make_docs(["x", "y", "z"]).select("doc_id", "text"), f"file://{tmp_path}/store")
    reads, manifest = [], store.manifest
    store.manifest = lambda *a: (reads.append(a), manifest(*a))[1]
    assert sorted(r.text for r in sharding.placed(store).collect()) == ["x", "y", "z"] and len(reads) == 1
