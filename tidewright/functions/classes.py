"""Classes, bands and calendar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnLike, col, finite

# Upper bounds (inclusive) of the WMO-based classes in metres, their names,
# and the edges of the sea-state code bands.
WMO_BOUNDS_M = (0.5, 1.25, 2.5)
WMO_CLASSES = ("smooth", "slight", "moderate", "rough_or_more")
SEA_STATE_EDGES = (0.0, 0.5, 1.25, 2.5, 4.0, 6.0, float("inf"))


def right_closed_class(value: ColumnLike, bounds: Sequence[float] = WMO_BOUNDS_M) -> Column:
    """The number of bounds strictly below the value; -1 where it is missing."""
    v = finite(value)
    n = sum((v > b).cast("int") for b in bounds)
    return F.coalesce(n, F.lit(-1))


def left_closed_bin(value: ColumnLike, edges: Sequence[float]) -> Column:
    """Index i of [edge_i, edge_i+1); -1 outside or missing."""
    v = finite(value)
    n = sum((v >= e).cast("int") for e in edges) - 1
    inside = (v >= edges[0]) & (v < edges[-1])
    return F.when(inside, n).otherwise(-1)


def band_label(value: ColumnLike, edges: Sequence[float] = SEA_STATE_EDGES) -> Column:
    """Text label ``[a, b)`` of the band; NULL outside."""
    v = col(value)
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((v >= lo) & (v < hi), f"[{lo:g}, {hi:g})").otherwise(out)
    return out


def near_boundary(value: ColumnLike, bounds: Sequence[float] = WMO_BOUNDS_M, rel_tol=0.04) -> Column:
    v = finite(value)
    hit = F.lit(False)
    for b in bounds:
        hit = hit | (F.abs(v - b) <= rel_tol * b)
    return F.coalesce(hit, F.lit(False))


def local_time(time: ColumnLike, tz: str) -> Column:
    return F.from_utc_timestamp(col(time).cast("timestamp"), tz)


def add_calendar(df, time: str, tz: str):
    """Civil day, ISO week, month and year of a zone."""
    local = local_time(time, tz)
    iso_year = F.extract(F.lit("YEAROFWEEK"), local)
    week = F.concat(iso_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(local).cast("string"), 2, "0"))
    return df.withColumns(
        {
            "local_day": F.date_format(local, "yyyy-MM-dd"),
            "local_week": week,
            "local_month": F.month(local),
            "local_year": F.year(local),
        }
    )


def season(time: ColumnLike) -> Column:
    """Meteorological season, December with the following months."""
    names = F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn")])
    index = F.floor(F.month(col(time)) % 12 / 3) + 1
    return F.element_at(names, index.cast("int"))


def gap_class(value: ColumnLike, low: float, high: float) -> Column:
    """0 below ``low``, 1 above ``high``; values between them are in no class (NULL)."""
    v = finite(value)
    return F.when(v < low, 0).when(v > high, 1)


def scaled_class(value: ColumnLike, scale: float, edges: Sequence[float]) -> Column:
    """Left-closed class of the scaled value between ``edges``; NULL outside them."""
    k = left_closed_bin(finite(value) * scale, edges)
    return F.when(k >= 0, k)
