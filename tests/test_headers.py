import random

import pytest

from gridmeter.operators import headers

SCHEMA = "template int, doc int, header string"


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 50), (3, 100), (4, 34)])
def test_containment_by_brute_force(spark, seed, percent):
    rng = random.Random(seed)
    files = {(t, d): {"year"} | set(rng.sample("abcdefghij", rng.randint(0, 6))) for t in range(3) for d in range(t * 100, t * 100 + 40)}
    rows = [(t, d, h) for (t, d), held in files.items() for h in held for _ in range(rng.randint(1, 2))] + [(0, 999, None)]
    sets = {}
    for (t, _), held in files.items():
        sets[t, tuple(sorted(held))] = sets.get((t, tuple(sorted(held))), 0) + 1
    want = []
    for (t, a), n in sets.items():
        around = [m for (u, b), m in sets.items() if u == t and a != b and 100 * len(set(a) & set(b)) >= percent * len(a)]
        want.append((t, len(a), n, len(around), sum(around)))
    got = headers.header_agreement(spark.createDataFrame(rows, SCHEMA).repartition(4), percent).collect()
    assert sorted((r.template, r.n_headers, r.n_docs, r.n_containing_sets, r.n_containing_docs) for r in got) == sorted(want)


def test_common_headers_are_not_asked_for(spark):
    """A header of every set makes no candidates of sets that share nothing else."""
    rows = [(1, d, h) for d in range(60) for h in ("all", f"own{d}", f"more{d}")]
    sets = headers.header_sets(spark.createDataFrame(rows, SCHEMA))
    assert sets.count() == 60 and headers.containments(sets).count() == 0
    assert headers.header_agreement(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_of_header_rows(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, " a "), (1, 0, 1, 0, "b"), (1, 0, 2, 0, "c"), (1, 1, 0, 0, "z"), (1, 0, 0, 1, "a"), (1, 0, 1, 1, None), (1, 0, 1, 2, " ")], "doc int, sheet int, row int, col int, value string")
    regions = spark.createDataFrame([(1, 0, [0, 1]), (1, 0, [1]), (1, 1, [])], "doc int, sheet int, header_rows array<int>")
    assert sorted(map(tuple, headers.header_cells(cells, regions).collect())) == [(1, "a"), (1, "b")]
