"""Counter-based random numbers: a key's number is the same in every run, partition and engine.

48 bits of the key's md5 make a uniform number, a rational approximation of the normal distribution's inverse (relative error
under 1.2e-9) makes a normal one. Each has its SQL beside it, in the same order of operations.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's approximation of the normal quantile, middle part and tails.
MIDDLE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
MIDDLE_LOW = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_LOW = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL = 0.02425
BITS = 48


def uniform(*key: Column) -> Column:
    """Between 0 and 1; a null in the key counts as an empty string."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long") + F.lit(0.5)) / float(1 << BITS)


def _polynomial(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def quantile(u: Column) -> Column:
    """The normal number below which a share u lies."""
    mid = u - F.lit(0.5)
    square = mid * mid
    middle = _polynomial(MIDDLE_TOP, square) * mid / _polynomial(MIDDLE_LOW, square)
    far = F.sqrt(F.lit(-2.0) * F.ln(F.least(u, F.lit(1.0) - u)))
    tail = _polynomial(TAIL_TOP, far) / _polynomial(TAIL_LOW, far)
    return F.when(u < TAIL, tail).when(u > 1 - TAIL, -tail).otherwise(middle)


def normal(*key: Column) -> Column:
    return quantile(uniform(*key))


def uniform_of(*key) -> float:
    """uniform() of plain values, for use inside tasks."""
    text = "|".join("" if k is None else str(k) for k in key)
    return (int(hashlib.md5(text.encode()).hexdigest()[: BITS // 4], 16) + 0.5) / float(1 << BITS)


def quantiles(u: np.ndarray) -> np.ndarray:
    """quantile() of an array."""
    mid, far = u - 0.5, np.sqrt(-2.0 * np.log(np.minimum(u, 1.0 - u)))
    middle = np.polyval(MIDDLE_TOP, mid * mid) * mid / np.polyval(MIDDLE_LOW, mid * mid)
    tail = np.polyval(TAIL_TOP, far) / np.polyval(TAIL_LOW, far)
    return np.where(u < TAIL, tail, np.where(u > 1 - TAIL, -tail, middle))


def uniform_sql(*key: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, {BITS // 4}))::BIGINT + 0.5::DOUBLE) / {float(1 << BITS)!r}::DOUBLE)"


def quantile_sql(u: str) -> str:
    """u: the name of a column."""
    poly = lambda cs, x: reduce(lambda acc, c: f"({acc} * {x} + ({c!r}::DOUBLE))", cs[1:], f"({cs[0]!r}::DOUBLE)")
    mid, far = f"({u} - 0.5::DOUBLE)", f"sqrt(-2.0::DOUBLE * ln(least({u}, 1.0::DOUBLE - {u})))"
    square, tail = f"({mid} * {mid})", f"({poly(TAIL_TOP, far)} / {poly(TAIL_LOW, far)})"
    return f"CASE WHEN {u} < {TAIL}::DOUBLE THEN {tail} WHEN {u} > {1 - TAIL!r}::DOUBLE THEN -{tail} ELSE {poly(MIDDLE_TOP, square)} * {mid} / {poly(MIDDLE_LOW, square)} END"
