"""Rates, intervals and Python-compatible rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The 97.5 % quantile of the standard normal distribution.
Z95 = 1.959963984540054


def wilson_low(passed: Column, n: Column, z: float = Z95) -> Column:
    """Lower bound of Wilson's interval, in [0, 1]; null where n is not positive."""
    return F.when(n > 0, F.greatest(F.lit(0.0), (_centre(passed, n, z) - _half(passed, n, z)) / _scale(n, z)))


def wilson_high(passed: Column, n: Column, z: float = Z95) -> Column:
    return F.when(n > 0, F.least(F.lit(1.0), (_centre(passed, n, z) + _half(passed, n, z)) / _scale(n, z)))


def _scale(n: Column, z: float) -> Column:
    return 1 + F.try_divide(F.lit(z * z), n)


def _centre(passed: Column, n: Column, z: float) -> Column:
    return F.try_divide(passed, n) + F.try_divide(F.lit(z * z), 2 * n)


def _half(passed: Column, n: Column, z: float) -> Column:
    p = F.try_divide(passed, n)
    return z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b; 0 on a zero denominator."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio_or_zero(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio_or_zero(tp, tp + fn)


def harmonic(p: Column, r: Column) -> Column:
    """F1 of two shares; 0 where both are."""
    return ratio_or_zero(2 * p * r, p + r)


@F.pandas_udf(DoubleType())
def _py_round(x, digits):
    import pandas as pd

    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def py_round(x: Column, digits: int) -> Column:
    """Half-even on the exact binary value, as Python rounds; no built-in does. For reports only."""
    return _py_round(x.cast("double"), F.lit(digits))
