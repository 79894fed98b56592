"""Boxes of a sheet that meet: close corners, overlaps and covered areas, without comparing all boxes of a sheet.

Boxes are inclusive and have the four sides as columns. Keys (document and sheet by default) stay in every join and group;
a sheet with most boxes of a table is dealt out by buckets, tiles or strips of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions import boxes as B
from ..sources.scratch import ship

#: The finest tiles have 2**6 rows and 2**5 columns; those of the next level 2**5 times as many.
_ROW_BITS, _COL_BITS, _STEP = 6, 5, 5
#: Rows of a strip in which areas are swept.
STRIP_ROWS = 1 << 14


def close_boxes(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, most: int) -> DataFrame:
    """Pairs of left's box struct a and right's b whose sides all differ by `most` at most.

    All four sides are bucketed. A right box stands in each bucket that a close left box may have: 2.4 of them on average.
    """
    width = 8 * max(most, 1)
    buckets = [f"_{s}" for s in B.SIDES]
    one = left.withColumns({k: F.floor(F.col(a)[s] / width) for k, s in zip(buckets, B.SIDES, strict=True)})
    many = right
    for k, s in zip(buckets, B.SIDES, strict=True):
        many = many.withColumn(k, F.explode(F.array_distinct(F.array(*(F.floor((F.col(b)[s] + d) / width) for d in (-most, most))))))
    return one.join(many, [*keys, *buckets]).drop(*buckets).filter(B.boundary_error(F.col(a), F.col(b)) <= most)


def _level(box: Column) -> Column:
    """The first level whose tiles a box spans no more than four of in each direction (five where it is not aligned)."""
    over = lambda first, last, bits: F.ceil((F.log2((box[last] - box[first] + 1).cast("double")) - bits - 2) / _STEP)
    return F.greatest(over("first_row", "last_row", _ROW_BITS), over("first_col", "last_col", _COL_BITS), F.lit(0)).cast("int")


def _in_tiles(df: DataFrame, box: str, levels: list[int]) -> DataFrame:
    """A row for each tile of the box, on its own level and on those coarser ones that any box has."""
    rows = df.filter((F.col(box)["last_row"] >= F.col(box)["first_row"]) & (F.col(box)["last_col"] >= F.col(box)["first_col"])).withColumn("_own", _level(F.col(box)))
    rows = rows.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("_own"))) if len(levels) > 1 else F.lit(levels[0]))
    tiles = lambda first, last, bits: F.expr(f"explode(sequence({_tile(f'{box}.{first}', bits)}, {_tile(f'{box}.{last}', bits)}))")
    return rows.withColumn("_r", tiles("first_row", "last_row", _ROW_BITS)).withColumn("_c", tiles("first_col", "last_col", _COL_BITS))


def _tile(cell: str, bits: int) -> str:
    return f"shiftright(cast({cell} as bigint), {bits} + {_STEP} * _level)"


def overlapping_boxes(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs of left's box struct a and right's b that share a cell, each once.

    Tiles have levels, each 32 times as high and wide as the one before, and a box lies in a few tiles of its own level. Two
    boxes meet on the coarser of their levels, in the tile that holds the first cell they share. Levels that no box has are
    left out; there are at most five for the rows of a sheet.
    """
    found = left.select(_level(F.col(a)).alias("level")).union(right.select(_level(F.col(b)).alias("level"))).distinct()
    levels = sorted(r.level for r in found.collect() if r.level is not None) or [0]  # a few numbers
    one, two = _in_tiles(left, a, levels).withColumnRenamed("_own", "_a"), _in_tiles(right, b, levels).withColumnRenamed("_own", "_b")
    both = one.join(two, [*keys, "_level", "_r", "_c"])
    here = lambda side, bits, name: F.expr(f"{_tile(f'greatest({a}.{side}, {b}.{side})', bits)} = {name}")
    met = both.filter((F.col("_level") == F.greatest("_a", "_b")) & here("first_row", _ROW_BITS, "_r") & here("first_col", _COL_BITS, "_c") & (B.overlap(F.col(a), F.col(b)) > 0))
    return met.drop("_level", "_r", "_c", "_a", "_b")


class CoveredLength:
    """A segment tree over column edges: how many columns any box of one side, of the other, and of both sides covers just now."""

    def __init__(self, edges: list[int]):
        self.n = n = 1 << max(0, (len(edges) - 2).bit_length())
        widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        self.size = [0] * n + widths + [0] * (n - len(widths))
        for i in range(n - 1, 0, -1):
            self.size[i] = self.size[2 * i] + self.size[2 * i + 1]
        self.count = [[0] * (2 * n), [0] * (2 * n)]
        self.covered = [[0] * (2 * n), [0] * (2 * n), [0] * (2 * n)]

    def _pull(self, i: int) -> None:
        (ones, others), (one, other, both), size = self.count, self.covered, self.size[i]
        left = 2 * i
        leaf = i >= self.n
        one[i] = size if ones[i] else 0 if leaf else one[left] + one[left + 1]
        other[i] = size if others[i] else 0 if leaf else other[left] + other[left + 1]
        both[i] = other[i] if ones[i] else one[i] if others[i] else 0 if leaf else both[left] + both[left + 1]

    def add(self, side: int, first: int, end: int, by: int) -> None:
        """A box's column intervals [first, end) come (by 1) or go (by -1)."""
        a, b, count, touched = first + self.n, end + self.n, self.count[side], set()
        while a < b:
            if a & 1:
                count[a] += by
                touched.add(a)
                a += 1
            if b & 1:
                b -= 1
                count[b] += by
                touched.add(b)
            a >>= 1
            b >>= 1
        while touched:  # all climb to the root, each a level a round
            for i in touched:
                self._pull(i)
            touched = {i >> 1 for i in touched if i > 1}


def swept(boxes: Iterable[tuple[int, int, int, int, int]]) -> tuple[int, int, int]:
    """Cells that boxes (side, first row, first column, last row, last column) of side 0, of side 1, and of both cover.

    A line sweeps the rows; at each row where boxes begin or end the tree gives the covered columns. The work is linear in
    boxes, but for a logarithm.
    """
    boxes = list(boxes)
    if len(boxes) == 1:
        side, r0, c0, r1, c1 = boxes[0]
        area = (r1 - r0 + 1) * (c1 - c0 + 1)
        return (0, area, 0) if side else (area, 0, 0)
    edges = sorted({c for b in boxes for c in (b[2], b[4] + 1)})
    place = {c: i for i, c in enumerate(edges)}
    events = sorted([(b[1], 1, b) for b in boxes] + [(b[3] + 1, -1, b) for b in boxes], key=lambda e: e[0])
    tree, at, sums = CoveredLength(edges), events[0][0], [0, 0, 0]
    for row, by, (side, _, c0, _, c1) in events:
        if row > at:
            for k in range(3):
                sums[k] += (row - at) * tree.covered[k][1]
            at = row
        tree.add(side, place[c0], place[c1 + 1], by)
    return sums[0], sums[1], sums[2]


def _sweeper(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["boxes"]
            rows = np.stack([held.flatten().field(i).to_numpy() for i in range(5)], axis=1).tolist()
            ends = np.cumsum(held.value_lengths().to_numpy()).tolist()
            areas = list(zip(*(swept(rows[a:b]) if b > a else (0, 0, 0) for a, b in zip([0, *ends], ends, strict=False)), strict=True)) or [(), (), ()]
            columns = [*(batch[k] for k in keys), batch["known"], *(pa.array(a, pa.int64()) for a in areas)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def union_areas(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str, str]) -> DataFrame:
    """keys and the cells that any box of left, any of right, and both cover, of every key that left has.

    Boxes are cut at strips of STRIP_ROWS rows, so that a large sheet is swept in several tasks, and equal pieces of a strip
    become one before they are dealt. A strip's distinct pieces are held together. Boxes turned inside out cover nothing.
    """
    proper = (F.col("last_row") >= F.col("first_row")) & (F.col("last_col") >= F.col("first_col"))
    sides = [df.select(*keys, F.lit(i).cast("long").alias("side"), *(F.col(s).cast("long").alias(s) for s in B.SIDES), F.coalesce(proper, F.lit(False)).alias("proper")) for i, df in enumerate((left, right))]
    strips = F.when(F.col("proper"), F.sequence(F.floor(F.col("first_row") / STRIP_ROWS), F.floor(F.col("last_row") / STRIP_ROWS))).otherwise(F.array(F.lit(0).cast("long")))
    cut = sides[0].unionByName(sides[1]).withColumn("strip", F.explode(strips))
    piece = F.struct("side", F.greatest("first_row", F.col("strip") * STRIP_ROWS).alias("r0"), F.col("first_col").alias("c0"), F.least("last_row", (F.col("strip") + 1) * STRIP_ROWS - 1).alias("r1"), F.col("last_col").alias("c1"))
    held = cut.groupBy(*keys, "strip").agg(F.collect_set(F.when(F.col("proper"), piece)).alias("boxes"), F.max(F.col("side") == 0).alias("known"))
    schema = StructType([left.schema[k] for k in keys] + [StructField("known", BooleanType())] + [StructField(n, LongType()) for n in names])
    ship(left.sparkSession)
    areas = held.mapInArrow(_sweeper(keys, _arrow(schema)), schema)
    return areas.groupBy(*keys).agg(F.max("known").alias("known"), *(F.sum(n).alias(n) for n in names)).filter("known").drop("known")


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
