"""Windows inside clips, as integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnLike, col


def midpoint_window(duration_s: ColumnLike, windows: ColumnLike, span_s: float = 16.0) -> Column:
    """Number of the window that holds the clip's midpoint, counted from 0; NULL for a clip without a window."""
    k = col(windows)
    return F.when(k >= 1, F.least(k - 1, F.floor(col(duration_s) / 2 / span_s))).cast("long")


def centred_windows(middle: ColumnLike, windows: ColumnLike, n: int = 11) -> tuple[Column, Column]:
    """(first, end) of the ``n`` windows around one, end exclusive, moved to lie inside the clip; all if it has fewer."""
    k = col(windows)
    first = F.greatest(F.lit(0), F.least(col(middle) - n // 2, F.greatest(k - n, F.lit(0)))).cast("long")
    return first, F.least(k, first + n).cast("long")
