"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to unit length (the largest cosine is then the least distance) and projected to a few
dimensions by a Gaussian, 2-stable matrix: the squared projected distance of two vectors, over their squared
distance, has a chi-square distribution. A kd-tree over a bounded sample cuts the projected space into
cells; a large cell is dealt to several blocks; each block has a kd-tree of its own.

A query first searches its own cell, which gives a k-th distance d. Then it visits the cells, and in each
block the leaves, by growing projected distance p, verifies what it meets with the original vectors,
which improves d, and stops where the test holds: p**2 > d**2 * the `confidence` quantile. A true
neighbour is thus missed with a probability of 1 - confidence at most.

Equal vectors are searched as one, with the smallest ids that an answer can need, so that one vector may
hold most rows. Queries and rows meet only in blocks.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, neither
do vectors whose length isn't the commonest one (the shorter on a tie); ids that repeat count once (with
one of their vectors, the least); fewer candidates than k give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, small_batches

DIMENSIONS, CONFIDENCE, SEED = 8, 0.98, 11
#: Vectors in a block and in a leaf; rows of the sample and depth of the cells (2**depth of them at most).
BLOCK, LEAF, SAMPLE, DEPTH = 8192, 256, 20_000, 10
_FOUND = "q long, vid long, score double, far double"


def chi_square_quantile(p: float, dimensions: int) -> float:
    """For an even number of dimensions."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dimensions // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(mid) < p else (low, mid)
    return high


def projection(size: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, dimensions))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True)  # against overflow
    m = m / scale
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Cells:
    """A kd-tree's cells: boxes of the projected space."""

    def __init__(self, points: np.ndarray, depth: int):
        d = points.shape[1]
        self.splits: list[tuple[int, float] | None] = []
        boxes = [(np.full(d, -np.inf), np.full(d, np.inf))]
        groups = [points]
        for _ in range(depth):
            new_boxes, new_groups = [], []
            for (low, high), g in zip(boxes, groups, strict=True):
                axis = int(np.ptp(g, axis=0).argmax()) if len(g) > 1 else 0
                cut = float(np.median(g[:, axis])) if len(g) else 0.0
                self.splits.append((axis, cut))
                left, right = high.copy(), low.copy()
                left[axis], right[axis] = min(high[axis], cut), max(low[axis], cut)
                new_boxes += [(low, left), (right, high)]
                under = g[:, axis] < cut
                new_groups += [g[under], g[~under]]
            boxes, groups = new_boxes, new_groups
        self.depth, self.low, self.high = depth, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        axes, cuts = np.array([s[0] for s in self.splits] or [0]), np.array([s[1] for s in self.splits] or [0.0])
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (points[np.arange(len(points)), axes[at]] >= cuts[at])
        return node

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from the point to every cell."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


class Block:
    """A kd-tree of the projected points of a block, in leaves."""

    def __init__(self, units: np.ndarray, projected: np.ndarray):
        self.units, self.projected, self.leaves = units, projected, []
        todo = [np.arange(len(units))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                self.leaves.append(at)
                continue
            p = projected[at]
            axis = int(np.ptp(p, axis=0).argmax())
            order = np.argsort(p[:, axis], kind="stable")
            todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        self.low = np.array([projected[x].min(axis=0) for x in self.leaves])
        self.high = np.array([projected[x].max(axis=0) for x in self.leaves])

    def nearest(self, unit: np.ndarray, point: np.ndarray, k: int, far: float, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """Indices and cosines of the k nearest met; far: a squared distance within which k are known elsewhere."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        gap = (gap * gap).sum(axis=1)
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        for leaf in np.argsort(gap, kind="stable").tolist():
            if gap[leaf] > quantile * far:  # the chi-square test: whatever is nearer projects farther too rarely
                break
            at = self.leaves[leaf]
            step = self.projected[at] - point
            at = at[(step * step).sum(axis=1) <= quantile * far]
            if len(at):
                best, scores = np.concatenate([best, at]), np.concatenate([scores, self.units[at] @ unit])
                if len(best) > k:
                    top = np.argsort(-scores, kind="stable")
                    edge = scores[top[k - 1]] - 1e-12  # ties stay
                    stay = scores >= edge
                    best, scores = best[stay], scores[stay]
                if len(best) >= k:
                    far = min(far, max(0.0, 2 - 2 * float(np.sort(scores)[-k])) + 1e-9)
        return best, scores


def _tame(v: str) -> Column:
    """A vector whose squares neither overflow nor vanish: extreme ones are scaled by a power of two, which is exact and leaves cosines alone."""
    most = F.array_max(F.transform(v, F.abs))
    exponent = -F.floor(F.log2(most))  # up to 1074, more than one factor can hold
    first = F.least(exponent, F.lit(1000))
    return F.when(most.between(1e-100, 1e100), F.col(v)).otherwise(F.transform(v, lambda x: x * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), exponent - first)))


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id, v (doubles, all finite, not all zero, of the commonest length) and that length."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").filter(~bad).filter(F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return v, 0
    return v.filter(F.size("v") == sizes[0]).groupBy("id").agg(F.min("v").alias("v")), sizes[0]


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each row whose id is divisible by every, itself excepted."""
    spark = rows.sparkSession
    small_batches(spark, 4096, 8 << 20)
    found, size = _vectors(rows, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return empty
    found = materialize(found)
    limited = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    groups = found.withColumn("r", limited).filter(F.col("r") <= k + 1).groupBy("v").agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids"))
    groups = materialize(groups)
    n = groups.count()
    matrix, quantile = projection(size), chi_square_quantile(confidence, DIMENSIONS)
    sample = groups.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("v").toArrow()
    depth = max(0, min(DEPTH, math.ceil(math.log2(max(1, n / BLOCK)))))
    cells = Cells(_unit(_matrix(sample["v"], size)) @ matrix, depth)

    def place(batches):
        for b in batches:
            cell = cells.of(_unit(_matrix(b["v"], size)) @ matrix) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b["vid"], b["v"], pa.array(cell.astype(np.int32))], ["vid", "v", "cell"])

    placed = groups.select("vid", "v").mapInArrow(place, "vid long, v array<double>, cell int")
    placed = materialize(placed)
    salts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))  # at most 2**DEPTH rows
    salts = F.broadcast(salts)
    data = placed.join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("vid"), F.col("salts")).cast("int")).select("cell", "salt", "vid", "v")
    asked = found.filter(F.col("id") % every == 0)
    first = asked.groupBy("v").agg(F.min("id").alias("q"))
    queries = materialize(first.select(F.col("q").alias("vid"), "v").mapInArrow(place, "vid long, v array<double>, cell int").withColumnRenamed("vid", "q"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            units = _unit(_matrix(left["v"], size))
            tree, vids = Block(units, units @ matrix), left["vid"].to_numpy()
            asked = _unit(_matrix(right["v"], size))
            for q, unit, point, far in zip(right["q"].to_pylist(), asked, asked @ matrix, right["far"].to_pylist(), strict=True):
                best, scores = tree.nearest(unit, point, k + 1, far, quantile)
                out += [(q, int(vids[i]), float(s), far) for i, s in zip(best.tolist(), scores.tolist(), strict=True)]
        q, vid, score, far = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"q": pa.array(q, pa.int64()), "vid": pa.array(vid, pa.int64()), "score": pa.array(score, pa.float64()), "far": pa.array(far, pa.float64())})

    def meet(visits: DataFrame) -> DataFrame:
        to = visits.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("cell", "salt", "q", "v", "far")
        return data.groupBy("cell", "salt").cogroup(to.groupBy("cell", "salt")).applyInArrow(block, _FOUND)

    near = materialize(meet(queries.withColumn("far", F.lit(8.0))))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vid"))
    bound = near.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("q").agg(F.when(F.count("*") > k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score")) + 1e-9).otherwise(8.0).alias("far"))

    def others(batches):
        for b in batches:
            out: list[tuple] = []
            points = _unit(_matrix(b["v"], size)) @ matrix if b.num_rows else []
            for i, (own, point, far) in enumerate(zip(b["cell"].to_pylist(), points, b["far"].to_pylist(), strict=True)):
                out += [(i, c, far) for c in np.flatnonzero(cells.distances(point) <= quantile * far).tolist() if c != own]
            rows_, c, far = zip(*out, strict=True) if out else ((), (), ())
            picked = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([b["q"].take(picked), b["v"].take(picked), pa.array(c, pa.int32()), pa.array(far, pa.float64())], ["q", "v", "cell", "far"])

    visits = queries.join(bound, "q", "left").withColumn("far", F.coalesce("far", F.lit(8.0))).select("q", "v", "cell", "far").mapInArrow(others, "q long, v array<double>, cell int, far double")
    all_found = near.unionByName(meet(visits)).select("q", "vid")
    # exact scores on the original vectors, answers for every query row, ties to the smaller id
    v, a = found.select(F.col("id").alias("vid"), _tame("v").alias("w")), queries.select("q", _tame("v").alias("a"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    pairs = all_found.distinct().join(v, "vid").join(a, "q").select("q", "vid", (dot("a", "w") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("w", "w")))).alias("score"))
    top = pairs.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k + 1).drop("r")
    lists = top.join(groups.select("vid", "ids"), "vid").select("q", "score", F.explode("ids").alias("vec_id"))
    rows_of = asked.join(first, "v").select("q", F.col("id").alias("query_id"))
    small = lists.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    answers = rows_of.join(small, "q").filter("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
