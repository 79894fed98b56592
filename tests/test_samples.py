"""Samples against Python's own, drawn from lists."""

import hashlib
from random import Random

import pytest

from gridmeter.operators import sampling, selection


def drawn(pool, cell, n, seed):
    """(attempt, status, keys) of one cell, as a list in memory gives them."""
    pool = sorted(pool)
    possible = len({s for _, s in pool}) >= 2
    for attempt in range(20 if possible else 1):
        own = int(hashlib.sha256(f"{seed}:{cell}:{attempt}".encode()).hexdigest()[:16], 16)
        picked = Random(own).sample(pool, min(n, len(pool)))
        if possible and len({s for _, s in picked}) >= 2:
            return attempt, "ok", [k for k, _ in picked]
    return (20, "unsatisfied", [k for k, _ in picked]) if possible else (0, "impossible", [k for k, _ in picked])


@pytest.mark.parametrize("seed", [1, 7])
def test_stratified(spark, seed):
    rng = Random(seed)
    rows = [(f"c{i % 3}", i, rng.randrange(4)) for i in range(120)] + [("one", i, 5) for i in range(30)] + [("rare", i, int(i == 3)) for i in range(40)] + [("few", 1, 1), ("few", 2, 2), ("rarer", 0, 1)] + [("rarer", i, 0) for i in range(1, 900)]
    df = spark.createDataFrame(rows, "cell string, id long, survey int").repartition(5)
    got = {}
    for r in sampling.seeded_stratified(df, "cell", "id", "survey", 4, seed).collect():
        got.setdefault(r.cell, (r.attempt, r.status, []))[2].append(r.id)
    want = {c: drawn([(k, s) for x, k, s in rows if x == c], c, 4, seed) for c in {r[0] for r in rows}}
    assert {c: (a, s, sorted(k)) for c, (a, s, k) in got.items()} == {c: (a, s, sorted(k)) for c, (a, s, k) in want.items()}
    assert want["one"][1] == "impossible" and {want["rare"][0], want["rarer"][0]} - {0}


def test_flat(spark):
    df = spark.createDataFrame([(f"k{i % 90:03d}", i) for i in range(200)], "k string, v int").repartition(6)
    for n, seed in ((5, 3), (40, 1), (500, 2)):
        keys = sorted({f"k{i % 90:03d}" for i in range(200)})
        assert {r.k for r in sampling.flat_sample(df, "k", n, seed).collect()} == set(Random(seed).sample(keys, min(n, 90)))
    assert sampling.flat_sample(df.limit(0), "k", 3, 1).count() == 0


def test_places(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else "a", i % 7, i) for i in range(60)], "g string, o int, i int").repartition(7)
    got = selection.numbered(df, ["g"], ["o", "i"]).collect()
    for g in (None, "a"):
        mine = sorted((r.o, r.i) for r in got if r.g == g)
        assert [(r.o, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == mine and sorted(r.place for r in got if r.g == g) == list(range(len(mine)))
