"""Distribution functions and per-row scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnLike, col

# Rational approximation of the normal distribution function to double
# precision (Hart 1968, algorithm 5666, as published by West 2005), highest power first.
PHI_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
PHI_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# Two-sided standard normal quantiles of the usual central intervals.
CENTRAL_Z = {
    0.5: 0.6744897501960817,
    0.8: 1.2815515655446004,
    0.9: 1.6448536269514722,
    0.95: 1.959963984540054,
}


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: ColumnLike) -> Column:
    """Standard normal distribution function."""
    z = col(x)
    a = F.abs(z)
    density = F.exp(-a * a / 2)
    tail = density * _horner(PHI_NUMERATOR, a) / _horner(PHI_DENOMINATOR, a)
    far = density / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, tail).otherwise(far)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def normal_pdf(x: ColumnLike) -> Column:
    z = col(x)
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def gaussian_nll(y, mu, sigma) -> Column:
    s = col(sigma)
    z = (col(y) - col(mu)) / s
    return 0.5 * z * z + F.ln(s) + 0.5 * math.log(2 * math.pi)


def gaussian_crps(y, mu, sigma) -> Column:
    s = col(sigma)
    z = (col(y) - col(mu)) / s
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def lognormal_crps(y, mu_log, sigma_log) -> Column:
    """Closed form of Baran & Lerch (2015); an observation at or below zero counts as zero."""
    y, m, s = col(y), col(mu_log), col(sigma_log)
    w = (F.ln(F.when(y > 0, y)) - m) / s
    below = F.coalesce(normal_cdf(w), F.lit(0.0))
    shifted = F.coalesce(normal_cdf(w - s), F.lit(0.0))
    mean = F.exp(m + s * s / 2)
    return y * (2 * below - 1) - 2 * mean * (shifted + normal_cdf(s / math.sqrt(2)) - 1)


def floored_log(x: ColumnLike, floor: float = 0.05) -> Column:
    return F.ln(F.greatest(col(x), F.lit(floor)))


def seeded_hash(seed: int, *parts: ColumnLike) -> Column:
    """A 60-bit number from md5 of the seed and the parts; any engine can recompute it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def student_t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of a t statistic (one number per report, on the driver)."""
    return _incomplete_beta(dof / (dof + t * t), dof / 2, 0.5)


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total / a
