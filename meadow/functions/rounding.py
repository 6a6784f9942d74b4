"""Rounding of computed doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, places: int) -> Column:
    """Half away from zero, as Spark rounds; noise under 1e-9 doesn't decide a tie. (Python rounds halves to even.)"""
    return F.round(F.round(c, 9), places)


def half_up_scaled(c: Column, places: int) -> Column:
    """Half away from zero of c * 10^places as a double, as DuckDB rounds: 0.00145 * 10^4 lies below 14.5 and goes down."""
    return F.round(c * 10.0**places) / 10.0**places
