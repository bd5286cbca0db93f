"""Circular quantities in degrees (nautical, coming-from)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnLike, col


def wrap180(x: ColumnLike) -> Column:
    """[-180, 180): the wrap of label spreads and longitudes."""
    return F.pmod(col(x) + 180.0, F.lit(360.0)) - 180.0


def wrap_error(x: ColumnLike) -> Column:
    """(-180, 180]: the wrap of direction errors."""
    w = wrap180(x)
    return F.when(w == -180.0, 180.0).otherwise(w)


def angular_difference(true: ColumnLike, pred: ColumnLike) -> Column:
    """Signed smallest difference, prediction minus truth."""
    return wrap_error(col(pred) - col(true))


def direction(sin: ColumnLike, cos: ColumnLike) -> Column:
    """Direction in [0, 360) of a vector; a rounded 360 becomes 0."""
    d = F.pmod(F.degrees(F.atan2(col(sin), col(cos))), F.lit(360.0))
    return F.when(d >= 360.0, 0.0).otherwise(d)


def sin_deg(x: ColumnLike) -> Column:
    return F.sin(F.radians(col(x)))


def cos_deg(x: ColumnLike) -> Column:
    return F.cos(F.radians(col(x)))


def encode(angle: ColumnLike) -> Column:
    """An angle as a (sin, cos) struct, continuous across north."""
    return F.struct(sin_deg(angle).alias("sin"), cos_deg(angle).alias("cos"))


def decode(sin: ColumnLike, cos: ColumnLike) -> Column:
    """Inverse of :func:`encode`; the vector need not have length one."""
    return F.pmod(F.degrees(F.atan2(col(sin), col(cos))), F.lit(360.0))


def circular_mean(angle: ColumnLike, weight: ColumnLike = 1.0) -> Column:
    """Aggregate: direction of the weighted resultant."""
    w = col(weight)
    return decode(F.sum(w * sin_deg(angle)), F.sum(w * cos_deg(angle)))


def resultant_length(angle: ColumnLike) -> Column:
    """Aggregate: length of the mean vector."""
    return F.hypot(F.avg(cos_deg(angle)), F.avg(sin_deg(angle)))


def circular_std(angle: ColumnLike) -> Column:
    """Aggregate: sqrt(-2 ln R) in degrees."""
    r = F.greatest(resultant_length(angle), F.lit(1e-300))
    return F.degrees(F.sqrt(-2.0 * F.ln(r)))


def fourier_from_polar(alpha1, alpha2, r1, r2) -> tuple[Column, Column, Column, Column]:
    """(alpha1, alpha2, r1, r2) to the coefficients (a1, b1, a2, b2)."""
    one, two = F.radians(col(alpha1)), 2.0 * F.radians(col(alpha2))
    q1, q2 = col(r1), col(r2)
    return q1 * F.cos(one), q1 * F.sin(one), q2 * F.cos(two), q2 * F.sin(two)


def polar_from_fourier(a1, b1, a2, b2) -> tuple[Column, Column, Column, Column]:
    """Inverse of :func:`fourier_from_polar`, angles in [0, 360)."""
    full = F.lit(360.0)
    alpha1 = F.pmod(F.degrees(F.atan2(col(b1), col(a1))), full)
    alpha2 = F.pmod(0.5 * F.degrees(F.atan2(col(b2), col(a2))), full)
    return alpha1, alpha2, F.hypot(col(a1), col(b1)), F.hypot(col(a2), col(b2))
