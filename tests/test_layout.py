"""Box joins, sweeps, matching and quantiles against plain versions, on sheets small and large."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gridmeter.operators import layout, selection, spatial

BOX = "doc long, sheet string, idx int, first_row long, first_col long, last_row long, last_col long"


def random_boxes(rng, n, rows, cols, tall=0.2):
    out = []
    for i in range(n):
        a, b = rng.randrange(rows), rng.randrange(cols)
        h, w = (rng.randrange(rows), rng.randrange(cols)) if rng.random() < tall else (rng.randrange(6), rng.randrange(6))
        out.append((1 + i % 2, "s", i, a, b, a + h, b + w))
    return out


def iou(x, y):
    rows, cols = min(x[5], y[5]) - max(x[3], y[3]) + 1, min(x[6], y[6]) - max(x[4], y[4]) + 1
    if rows <= 0 or cols <= 0:
        return 0.0
    area = lambda b: (b[5] - b[3] + 1) * (b[6] - b[4] + 1)
    return rows * cols / (area(x) + area(y) - rows * cols)


def error(x, y):
    return max(abs(a - b) for a, b in zip(x[3:], y[3:], strict=True))


def greedy(gt, pred):
    order = sorted((error(p, g), -iou(p, g), p[2], g[2]) for p in pred for g in gt if error(p, g) <= 2)
    used_p, used_g, out = set(), set(), set()
    for be, _, p, g in order:
        if p not in used_p and g not in used_g:
            used_p.add(p)
            used_g.add(g)
            out.add((be, p, g))
    return out


@pytest.mark.parametrize(("seed", "rows", "cols"), [(1, 12, 8), (2, 90, 50), (3, 40_000, 3000)])
def test_pairs(spark, seed, rows, cols):
    rng = random.Random(seed)
    gt, pred = random_boxes(rng, 60, rows, cols), random_boxes(rng, 60, rows, cols)
    pred += [(g[0], g[1], 100 + g[2], *(max(0, v + rng.choice((-2, -1, 0, 1, 3))) for v in g[3:5]), g[5] + 3, g[6] + 3) for g in gt]
    left, right = spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX)
    close = {(r.doc, r.gi, r.pi, r.be) for r in layout.close_pairs(left, right).collect()}
    assert close == {(g[0], g[2], p[2], error(g, p)) for g in gt for p in pred if g[0] == p[0] and error(g, p) <= 2}
    met = layout.overlapping_pairs(left, right).collect()
    assert len(met) == len({(r.doc, r.gi, r.pi) for r in met})
    assert {(r.doc, r.gi, r.pi): r.iou for r in met} == {(g[0], g[2], p[2]): iou(g, p) for g in gt for p in pred if g[0] == p[0] and iou(g, p) > 0}
    best = {(r.doc, r.side, r.idx): r.best for r in layout.best_iou(left, right).collect()}
    assert best == {(x[0], name, x[2]): max((iou(x, y) for y in other if y[0] == x[0]), default=0.0) for name, some, other in (("gt", gt, pred), ("pred", pred, gt)) for x in some}


def test_joins_have_buckets_as_keys(spark):
    gt = spark.createDataFrame(random_boxes(random.Random(1), 20, 40, 9), BOX)
    for pairs, keys in ((layout.close_pairs(gt, gt), ["_first_row", "_last_col"]), (layout.overlapping_pairs(gt, gt), ["_r", "_c"])):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        condition = next(line for line in plan.splitlines() if "Join Inner" in line)
        assert all(re.search(rf"\({k}#\d+L = {k}#\d+L\)", condition) for k in keys), condition


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rounds(spark, seed):
    """Crowded boxes, equal ones among them: rounds of mutual bests are the greedy order."""
    rng = random.Random(seed)
    gt = [(1, "s", i, rng.randrange(6), rng.randrange(4), 6 + rng.randrange(4), 5 + rng.randrange(3)) for i in range(40)]
    pred = [(1, "s", i, rng.randrange(6), rng.randrange(4), 6 + rng.randrange(4), 5 + rng.randrange(3)) for i in range(50)]
    got = layout.greedy_matches(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX)).collect()
    assert {(r.be, r.pi, r.gi) for r in got} == greedy(gt, pred) and len(got) == len(greedy(gt, pred))


def test_a_chain_needs_rounds(spark):
    """Each box is nearer to the next one than that is to it, so that one pair is settled a round."""
    gt = [(1, "s", i, 0, 0, 10 + 5 * i, 5) for i in range(8)]
    pred = [(1, "s", i, 0, 0, 12 + 5 * i, 5) for i in range(8)]
    got = layout.greedy_matches(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX)).collect()
    assert {(r.be, r.pi, r.gi) for r in got} == greedy(gt, pred)


def test_no_close_boxes(spark):
    gt, pred = spark.createDataFrame([(1, "s", 0, 0, 0, 5, 5)], BOX), spark.createDataFrame([(1, "s", 0, 50, 50, 55, 55)], BOX)
    assert layout.greedy_matches(gt, pred).count() == 0
    assert [tuple(r) for r in layout.eob_by_sheet(gt, pred).orderBy("n").collect()] == [(1, "s", n, 0, 1, 1, 0.0) for n in (0, 1, 2)]
    assert layout.best_iou(gt, pred.limit(0)).collect()[0].best == 0.0


@pytest.mark.parametrize(("seed", "rows"), [(1, 12), (2, 60), (3, 60_000)])
def test_union_areas(spark, seed, rows):
    rng = random.Random(seed)
    gt, pred = random_boxes(rng, 30, rows, 9), random_boxes(rng, 30, rows, 9) + [(9, "s", 0, 1, 1, 2, 2)]
    gt += [(5, "s", 0, 4, 4, 2, 2), (6, "s", 0, 0, 0, 0, 0), (6, "s", 1, 0, 0, 0, 0)]
    got = {r.doc: (r.gt_area, r.pred_area, r.inter_area) for r in layout.union_areas(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX)).collect()}

    def cells(boxes, doc):
        return {(c, r) for b in boxes if b[0] == doc for c in range(b[4], b[6] + 1) for r in range(b[3], b[5] + 1)}

    want = {}
    for doc in (1, 2, 5, 6):
        g, p = cells(gt, doc), cells(pred, doc)
        want[doc] = (len(g), len(p), len(g & p))
    assert got == want


def test_a_sweep_is_nearly_linear():
    rng = random.Random(4)

    def took(n):
        boxes = [(rng.randint(0, 1), a := rng.randrange(100_000), b := rng.randrange(16_000), a + rng.randrange(3000), b + rng.randrange(300)) for _ in range(n)]
        began = time.process_time()
        spatial.swept(boxes)
        return time.process_time() - began

    small, large = min(took(2500) for _ in range(2)), took(10_000)
    assert large < 4 * 2.5 * small + 0.2  # quadratic work would take 16 times as long


def test_quantiles_of_large_and_odd_groups(spark):
    rng = random.Random(6)
    groups = {"a": [rng.random() for _ in range(2001)], "b": [0.0] * 300 + [1.0], "c": [5.0], None: [rng.choice([1e-300, 1.0, 1e300, -1e300, 3.0]) for _ in range(50)], "d": [10.0**i for i in range(-200, 200, 3)]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "side string, best double")
    got = {r.side: r for r in layout.summarize(rows, ["side"], "best").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = sorted(vs)
        assert got[k].n == len(vs)
        for q in (10, 25, 50, 75, 90):
            h = (len(vs) - 1) * (q / 100)
            lo = int(h)
            hi = min(lo + 1, len(vs) - 1)
            assert got[k][f"p{q}"] == vs[lo] + (vs[hi] - vs[lo]) * (h - lo), (k, q)
    assert layout.summarize(rows.limit(0), ["side"], "best").count() == 0
    whole = layout.summarize(rows.filter("side = 'a'"), [], "best").first()
    assert (whole.n, whole.p50) == (2001, sorted(groups["a"])[1000])


def test_rank_state_is_bounded_by_bins(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 4)
    counted = spark.range(1000).select(F.col("id").cast("double").alias("value"), F.lit(2).cast("long").alias("n"))
    ranks = spark.createDataFrame([(0,), (777,), (1999,)], "rank long")
    assert {r.rank: r.value for r in selection.order_statistics(counted, [], ranks).collect()} == {0: 0.0, 777: 388.0, 1999: 999.0}
