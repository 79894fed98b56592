"""Inclusive cell boxes as columns: first_row, first_col, last_row, last_col."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("first_row", "first_col", "last_row", "last_col")


def box(prefix: str = "") -> Column:
    """A struct of the four columns with a prefix."""
    return F.struct(*(F.col(f"{prefix}{s}").alias(s) for s in SIDES))


def area(b: Column) -> Column:
    return (b["last_row"] - b["first_row"] + 1) * (b["last_col"] - b["first_col"] + 1)


def overlap(a: Column, b: Column) -> Column:
    rows = F.least(a["last_row"], b["last_row"]) - F.greatest(a["first_row"], b["first_row"]) + 1
    cols = F.least(a["last_col"], b["last_col"]) - F.greatest(a["first_col"], b["first_col"]) + 1
    return F.greatest(rows, F.lit(0)) * F.greatest(cols, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b))


def boundary_error(a: Column, b: Column) -> Column:
    """The largest distance of corresponding edges."""
    return F.greatest(*(F.abs(a[s] - b[s]) for s in SIDES))


def make(first_row: Column, first_col: Column, last_row: Column, last_col: Column) -> Column:
    return F.struct(first_row.alias("first_row"), first_col.alias("first_col"), last_row.alias("last_row"), last_col.alias("last_col"))


def one_based(b: Column) -> Column:
    return make(*(b[s] + 1 for s in SIDES))


def zero_based(b: Column) -> Column:
    return make(*(b[s] - 1 for s in SIDES))


def clamped(b: Column, max_row: Column, max_col: Column) -> Column:
    """A 1-based box within the sheet; null if nothing of it is."""
    cut = make(F.greatest(b["first_row"], F.lit(1)), F.greatest(b["first_col"], F.lit(1)), F.least(b["last_row"], max_row), F.least(b["last_col"], max_col))
    return F.when(b.isNotNull() & (cut["first_row"] <= cut["last_row"]) & (cut["first_col"] <= cut["last_col"]), cut)


def moved(b: Column, edge: Column, delta: Column) -> Column:
    """One edge moved; null if the box turns inside out."""
    step = lambda name: F.when(edge == name, delta).otherwise(0)
    out = make(b["first_row"] + step("top"), b["first_col"] + step("left"), b["last_row"] + step("bottom"), b["last_col"] + step("right"))
    return F.when((out["first_row"] <= out["last_row"]) & (out["first_col"] <= out["last_col"]), out)


def grown(b: Column, delta: Column) -> Column:
    """All edges outwards by delta; null if nothing is left."""
    out = make(b["first_row"] - delta, b["first_col"] - delta, b["last_row"] + delta, b["last_col"] + delta)
    return F.when((out["first_row"] <= out["last_row"]) & (out["first_col"] <= out["last_col"]), out)


def bands(b: Column, k: Column) -> Column:
    """An array of k row bands, the first ones a row larger where rows don't divide; the box itself where it has under 2 k rows."""
    rows = b["last_row"] - b["first_row"] + 1
    base, rest = F.floor(rows / k), rows % k
    start = lambda i: (b["first_row"] + i * base + F.least(i, rest)).cast("long")
    parts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: make(start(i), b["first_col"].cast("long"), start(i + 1) - 1, b["last_col"].cast("long")))
    return F.when(rows >= 2 * k, parts).otherwise(F.array(make(*(b[s].cast("long") for s in SIDES))))


def from_a1(ref: Column) -> Column:
    """A 0-based box of a reference such as B3:F20 or B3; null if it is none."""
    part = lambda i: F.regexp_extract(F.upper(ref), r"^\$?([A-Z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Z]{1,3})\$?([0-9]{1,7}))?$", i)
    column = lambda letters: F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64)) - 1
    row = lambda digits: digits.try_cast("int") - 1
    c1, r1 = F.coalesce(F.nullif(part(3), F.lit("")), part(1)), F.coalesce(F.nullif(part(4), F.lit("")), part(2))
    return F.when(part(1) != "", make(row(part(2)), column(part(1)), row(r1), column(c1)))


def to_a1(b: Column) -> Column:
    """The reference of a 0-based box."""

    def letters(col: Column) -> Column:
        n = col + 1
        one = lambda x: F.char(x.cast("int") + 65)
        a, bb = F.floor((n - 1) / 26), (n - 1) % 26
        two = F.floor((a - 1) / 26)
        return F.concat(F.when(two > 0, one(two - 1)).otherwise(""), F.when(a > 0, one((a - 1) % 26)).otherwise(""), one(bb))

    corner = lambda r, c: F.concat(letters(b[c]), (b[r] + 1).cast("string"))
    return F.when((b["first_row"] == b["last_row"]) & (b["first_col"] == b["last_col"]), corner("first_row", "first_col")).otherwise(F.concat_ws(":", corner("first_row", "first_col"), corner("last_row", "last_col")))
