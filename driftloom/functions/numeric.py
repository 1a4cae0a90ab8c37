"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(column: Column | str) -> Column:
    """A column as a double in which every missing value, NaN too, is null; text that is no number is missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def missing(column: Column | str) -> Column:
    return clean(column).isNull().cast("int")


def clip(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), column))


def finite(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def r6(column: Column | str) -> Column:
    """Rounded for comparison; never a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6) + F.lit(0.0)
