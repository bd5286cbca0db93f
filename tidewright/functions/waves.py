"""Linear wave theory and parametric spectra as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import cos_deg
from .base import PI, ColumnLike, col

# Standard gravity; exponent of the explicit start of Guo (2002);
# k*h above which tanh is one in double precision; breaking steepness (Michell 1893).
G = 9.80665
GUO_BETA = 2.4908
DEEP_KH = 20.0
MICHELL_STEEPNESS = 0.142


def wavenumber(frequency: ColumnLike, depth: ColumnLike | None = None, steps: int = 6) -> Column:
    """k of the linear dispersion relation by Newton steps from Guo's explicit start.

    The start is within 0.75 %, so the quadratic iteration is at machine precision after
    four steps. Each step is kept as an array element, so the expression stays linear in
    the number of steps instead of doubling. A NULL depth means deep water.
    """
    w = 2 * PI * col(frequency)
    deep = w * w / G
    if depth is None:
        return deep
    h = col(depth)
    x = w * F.sqrt(h / G)
    start = F.pow(x, 2) * F.pow(1 - F.exp(-F.pow(x, GUO_BETA)), -1.0 / GUO_BETA) / h

    def newton(k: Column, _: Column) -> Column:
        t = F.tanh(F.least(k * h, F.lit(DEEP_KH)))
        return k - (G * k * t - w * w) / (G * t + G * k * h * (1 - t * t))

    return F.coalesce(F.reduce(F.sequence(F.lit(1), F.lit(steps)), start, newton), deep)


def wavelength(frequency, depth=None) -> Column:
    return 2 * PI / wavenumber(frequency, depth)


def phase_velocity(frequency, depth=None) -> Column:
    return 2 * PI * col(frequency) / wavenumber(frequency, depth)


def group_velocity(frequency, depth=None) -> Column:
    """Speed of the wave energy."""
    k = wavenumber(frequency, depth)
    c = 2 * PI * col(frequency) / k
    if depth is None:
        return 0.5 * c
    two_kh = 2 * k * col(depth)
    n = F.when(two_kh < 2 * DEEP_KH, 0.5 * (1 + two_kh / F.sinh(two_kh))).otherwise(0.5)
    return n * c


def deep_water_length(period) -> Column:
    return G * F.pow(col(period), 2) / (2 * PI)


def steepness(height, period, depth=None) -> Column:
    return col(height) / wavelength(1.0 / col(period), depth)


def iribarren(slope, height, period) -> Column:
    return col(slope) / F.sqrt(col(height) / deep_water_length(period))


def ursell(height, period, depth) -> Column:
    h = col(depth)
    return col(height) * F.pow(wavelength(1.0 / col(period), h), 2) / F.pow(h, 3)


def propagation_lag_s(distance_m, peak_period, depth=None) -> Column:
    """Travel time of the peak component over a distance."""
    return col(distance_m) / group_velocity(1.0 / col(peak_period), depth)


def directional_lag_s(distance_m, bearing_deg, peak_direction, peak_period, depth=None) -> Column:
    """Travel time along the wave direction; waves come from ``peak_direction``."""
    along = col(distance_m) * cos_deg(col(peak_direction) + 180 - col(bearing_deg))
    return along / group_velocity(1.0 / col(peak_period), depth)


def pierson_moskowitz(f, hs, tp) -> Column:
    f, fp = col(f), 1.0 / col(tp)
    s = (5 / 16) * F.pow(col(hs), 2) * F.pow(fp, 4) * F.pow(f, -5)
    return F.when(f > 0, s * F.exp(-1.25 * F.pow(fp / f, 4))).otherwise(0.0)


def jonswap(f, hs, tp, gamma: float = 3.3, sigma_a: float = 0.07, sigma_b: float = 0.09) -> Column:
    """Unnormalised JONSWAP density in the form of Goda (1988)."""
    f, hs, tp = col(f), col(hs), col(tp)
    beta = 0.0624 / (0.230 + 0.0336 * gamma - 0.185 / (1.9 + gamma))
    beta *= 1.094 - 0.01915 * math.log(gamma)
    sigma = F.when(f <= 1.0 / tp, sigma_a).otherwise(sigma_b)
    peak = F.exp(-F.pow(f * tp - 1, 2) / (2 * sigma * sigma))
    s = beta * hs * hs * F.pow(tp, -4) * F.pow(f, -5) * F.exp(-1.25 * F.pow(tp * f, -4))
    return F.when(f > 0, s * F.pow(F.lit(gamma), peak)).otherwise(0.0)


def cos2s_spreading(direction, mean_direction, s: float) -> Column:
    """cos-2s directional spreading per radian; the constant is closed form in ``s``."""
    log_c = (2 * s - 1) * math.log(2) + 2 * math.lgamma(s + 1) - math.log(PI) - math.lgamma(2 * s + 1)
    half = F.radians(col(direction) - col(mean_direction)) / 2
    return math.exp(log_c) * F.pow(F.abs(F.cos(half)), 2 * s)


def cos2s_moments(s: ColumnLike) -> tuple[Column, Column]:
    s = col(s)
    return s / (s + 1), s * (s - 1) / ((s + 1) * (s + 2))
