"""Small helpers used by all column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
US = 1_000_000
HOUR_US = 3600 * US
DAY_US = 24 * HOUR_US

ColumnLike = Column | str | int | float


def col(x: ColumnLike) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def micros(time: ColumnLike) -> Column:
    """Microseconds since the epoch of a timestamp (the session runs in UTC)."""
    return F.unix_micros(col(time).cast("timestamp"))


def from_micros(us: ColumnLike) -> Column:
    return F.timestamp_micros(col(us))


def duration_us(text: str | int | float) -> int:
    """``'30min'``, ``'24h'``, ``'8d'``, ``'15s'`` or a number of seconds, as microseconds."""
    if not isinstance(text, str):
        return int(round(text * US))
    for unit, size in (("min", 60), ("ms", 0.001), ("d", 86400), ("h", 3600), ("s", 1)):
        if text.endswith(unit):
            return int(round(float(text[: -len(unit)]) * size * US))
    raise ValueError(f"unknown duration {text!r}")


def finite(x: ColumnLike) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    v = col(x).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def divide(a: Column, b: Column) -> Column:
    """NULL instead of an error or infinity for a zero denominator."""
    return F.when(b != 0, a / b)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))
