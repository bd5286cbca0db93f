"""Wave spectra as long tables: one row per (record, frequency bin)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waves
from ..functions.angles import fourier_from_polar
from ..functions.base import PI, divide, finite
from .ordered import Next, Prev, ordered

FREQ, WIDTH, DENSITY = "frequency_hz", "bandwidth_hz", "spectral_density_m2_hz"


def bin_edges(grids: DataFrame, grid: Sequence[str], frequency: str = FREQ, *, limit=None) -> DataFrame:
    """``edge_lo``, ``edge_hi`` and ``bandwidth_hz`` of each bin from the midpoints of its centres.

    The outer edges mirror the nearest midpoint; the lowest edge is not below zero. ``grids``
    should hold each distinct grid once, not every record.
    """
    seen = ordered(
        grids, grid, [frequency], limit=limit, _p=Prev(F.col(frequency)), _q=Next(F.col(frequency))
    )
    f, p, q = F.col(frequency), F.col("_p"), F.col("_q")
    below, above = 0.5 * (f + p), 0.5 * (q + f)
    lo = F.when(p.isNotNull(), below).otherwise(F.greatest(f - (above - f), F.lit(0.0)))
    hi = F.when(q.isNotNull(), above).otherwise(f + (f - below))
    return seen.withColumns({"edge_lo": lo, "edge_hi": hi, WIDTH: hi - lo}).drop("_p", "_q")


def grid_id(spectra: DataFrame, record: Sequence[str], frequency: str = FREQ) -> DataFrame:
    """An order-free fingerprint of each record's frequency grid.

    Sums and XORs of per-bin hashes combine map-side, so no grid is collected into an array.
    """
    h = F.xxhash64(F.round(frequency, 5))
    parts = spectra.groupBy(*record).agg(
        F.count(F.lit(1)).alias("n_bins"), F.bit_xor(h).alias("_x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("_s")
    )
    return parts.select(*record, "n_bins", F.xxhash64("n_bins", "_x", "_s").alias("grid_id"))


def _band(fmin: float | None, fmax: float | None) -> Column:
    band = F.lit(True)
    if fmin is not None:
        band = band & (F.col(FREQ) >= fmin)
    if fmax is not None:
        band = band & (F.col(FREQ) <= fmax)
    return band


def moment(n: float, missing: str = "null") -> Column:
    """Aggregate: integral of f^n S df. With ``missing='null'`` any missing bin voids it."""
    if missing not in ("null", "zero"):
        raise ValueError("missing is 'null' or 'zero'")
    s = finite(DENSITY)
    total = F.sum(F.pow(F.col(FREQ), float(n)) * s * F.col(WIDTH)) if n else F.sum(s * F.col(WIDTH))
    if missing == "zero":
        return F.coalesce(total, F.lit(0.0))
    return F.when(F.count_if(s.isNull()) == 0, total)


def moments(spectra, record, orders: dict[str, float], fmin=None, fmax=None, missing="null") -> DataFrame:
    cut = spectra.where(_band(fmin, fmax))
    return cut.groupBy(*record).agg(*[moment(n, missing).alias(k) for k, n in orders.items()])


def bulk_parameters(
    spectra: DataFrame, record: Sequence[str], fmin=None, fmax=None, *, directional: bool = False
) -> DataFrame:
    """Integral parameters of each record in a single aggregate."""
    s, f, df = finite(DENSITY), F.col(FREQ), F.col(WIDTH)
    s0 = F.coalesce(s, F.lit(0.0))
    peak_order = F.struct(F.coalesce(-s, F.lit(float("inf"))).alias("o"), f.alias("f"))
    fields = [f.alias("f"), s.alias("s")]
    aggs = [
        moment(0).alias("m0"), moment(1).alias("m1"), moment(2).alias("m2"), moment(-1).alias("m_1"),
        F.sum(F.pow(s0, 4) * f * df).alias("_s4f"), F.sum(F.pow(s0, 4) * df).alias("_s4"),
        F.sum(s0 * s0 * f * df).alias("_s2f"), F.max(s).alias("_smax"),
    ]
    if directional:
        a1, b1, _, _ = fourier_from_polar(*[finite(c) for c in ("alpha1", "alpha2", "r1", "r2")])
        e = F.when(a1.isNotNull(), s0 * df)
        fields += [finite("alpha1").alias("d"), finite("r1").alias("r")]
        aggs += [F.sum(e).alias("_e"), F.sum(a1 * e).alias("_ae"), F.sum(b1 * e).alias("_be")]
    aggs.append(F.min_by(F.struct(*fields), peak_order).alias("_peak"))
    g = spectra.where(_band(fmin, fmax)).groupBy(*record).agg(*aggs)
    m0, m1, m2 = F.col("m0"), F.col("m1"), F.col("m2")
    tp = F.when(F.col("_smax") > 0, divide(F.lit(1.0), F.col("_peak.f")))
    hm0 = 4.0 * F.sqrt(m0)
    out = {
        "m0": m0,
        "Hm0": hm0,
        "Tp": tp,
        "Tp_smooth": divide(F.col("_s4"), F.col("_s4f")),
        "Tm01": divide(m0, m1),
        "Tm02": F.sqrt(divide(m0, m2)),
        "Tm_10": divide(F.col("m_1"), m0),
        "nu": finite(F.sqrt(divide(m0 * m2, m1 * m1) - 1.0)),
        "Qp": divide(2.0 * F.col("_s2f"), m0 * m0),
        "steepness_p": divide(2 * PI * hm0, waves.G * tp * tp),
    }
    if directional:
        a, b = divide(F.col("_ae"), F.col("_e")), divide(F.col("_be"), F.col("_e"))
        out["Dp"] = F.col("_peak.d")
        out["Dm"] = F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))
        out["spread_m"] = finite(F.degrees(F.sqrt(2.0 * (1.0 - F.hypot(a, b)))))
        out["spread_p"] = finite(F.degrees(F.sqrt(2.0 * (1.0 - F.col("_peak.r")))))
    return g.select(*record, *[v.alias(k) for k, v in out.items()])


def mean_square_slope(spectra: DataFrame, record: Sequence[str], missing: str = "zero") -> DataFrame:
    """m0 and the integral of S k^2 df with the deep-water wavenumber."""
    k2 = F.pow(waves.wavenumber(FREQ), 2)
    s = finite(DENSITY)
    slope = F.sum(s * k2 * F.col(WIDTH))
    slope = F.coalesce(slope, F.lit(0.0)) if missing == "zero" else F.when(F.count_if(s.isNull()) == 0, slope)
    return spectra.groupBy(*record).agg(moment(0, missing).alias("m0"), slope.alias("mss"))


def regrid(spectra: DataFrame, record: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Density on new bins, conserving variance; needs ``edge_lo`` and ``edge_hi`` per row.

    A target bin is NULL if it reaches outside the source range or touches a missing bin.
    """
    s = F.col("_s")
    # The bins are a fixed parameter list: two sums for each, so a record is one row until its bins are told apart.
    aggs, bins = [], []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        lo, hi = F.lit(float(a)), F.lit(float(b))
        overlap = F.greatest(F.least(F.col("edge_hi"), hi) - F.greatest(F.col("edge_lo"), lo), F.lit(0.0))
        aggs += [F.sum(s * overlap).alias(f"_e{k}"), F.count_if(s.isNull() & (overlap > 0)).alias(f"_gaps{k}")]
        here = F.struct(lo.alias("lo"), hi.alias("hi"))
        bins.append(F.struct(here.alias("_b"), F.col(f"_e{k}").alias("_e"), F.col(f"_gaps{k}").alias("_gaps")))
    whole = spectra.select(*record, "edge_lo", "edge_hi", finite(DENSITY).alias("_s")).groupBy(*record)
    whole = whole.agg(*aggs, F.min("edge_lo").alias("_lo"), F.max("edge_hi").alias("_hi"))
    parts = whole.select(*record, "_lo", "_hi", F.inline(F.array(*bins)))
    inside = (F.col("_b.lo") >= F.col("_lo") - 1e-12) & (F.col("_b.hi") <= F.col("_hi") + 1e-12)
    density = F.when(inside & (F.col("_gaps") == 0), F.col("_e") / (F.col("_b.hi") - F.col("_b.lo")))
    return parts.select(
        *record, F.col("_b.lo").alias("edge_lo"), F.col("_b.hi").alias("edge_hi"), density.alias(DENSITY)
    )


def directional_distribution(spectra: DataFrame, directions: Sequence[float], method: str = "mem") -> DataFrame:
    """Adds ``distribution``: D(theta) per radian on the given grid, integrating to one.

    Complex arithmetic is written out in real parts. The grid is a short fixed array per row,
    so no shuffle is needed.
    """
    a1, b1, a2, b2 = fourier_from_polar("alpha1", "alpha2", "r1", "r2")
    grid = F.array(*[F.lit(float(d)) for d in directions])
    base = spectra.withColumns({"_a1": a1, "_b1": b1, "_a2": a2, "_b2": b2})
    a1, b1, a2, b2 = (F.col(c) for c in ("_a1", "_b1", "_a2", "_b2"))
    if method == "fourier":
        def density(th: Column) -> Column:
            t = F.radians(th)
            series = a1 * F.cos(t) + b1 * F.sin(t) + a2 * F.cos(2 * t) + b2 * F.sin(2 * t)
            return (1 + 2 * series) / (2 * PI)
    elif method == "mem":
        # phi1 = (c1 - c2 conj(c1)) / (1 - |c1|^2), phi2 = c2 - c1 phi1
        room = 1 - (a1 * a1 + b1 * b1)
        base = base.withColumns(
            {
                "_p1r": divide(a1 - (a2 * a1 + b2 * b1), room),
                "_p1i": divide(b1 - (b2 * a1 - a2 * b1), room),
            }
        )
        p1r, p1i = F.col("_p1r"), F.col("_p1i")
        base = base.withColumns(
            {"_p2r": a2 - (a1 * p1r - b1 * p1i), "_p2i": b2 - (a1 * p1i + b1 * p1r)}
        )
        p2r, p2i = F.col("_p2r"), F.col("_p2i")
        top = 1 - (p1r * a1 + p1i * b1) - (p2r * a2 + p2i * b2)

        def density(th: Column) -> Column:
            t = F.radians(th)
            re = 1 - (p1r * F.cos(t) + p1i * F.sin(t)) - (p2r * F.cos(2 * t) + p2i * F.sin(2 * t))
            im = -(p1i * F.cos(t) - p1r * F.sin(t)) - (p2i * F.cos(2 * t) - p2r * F.sin(2 * t))
            return top / (2 * PI * (re * re + im * im))
    else:
        raise ValueError(f"unknown method {method!r}")
    step = 2 * PI / len(directions)
    raw = base.withColumn("_d", F.transform(grid, density))
    norm = F.aggregate("_d", F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))) * step
    out = raw.withColumn("_norm", norm).withColumn(
        "distribution", F.transform("_d", lambda x: divide(x, F.col("_norm")))
    )
    return out.select(*spectra.columns, "distribution")


def join_products(density: DataFrame, record: Sequence[str], **products: DataFrame) -> DataFrame:
    """Directional products joined to the density by record and frequency; density rows all stay.

    Each product holds ``record, frequency_hz, value, line_no``; the first line wins.
    """
    out = density
    for name, p in products.items():
        first = p.groupBy(*record, FREQ).agg(F.min_by("value", "line_no").alias(name))
        out = out.join(first, [*record, FREQ], "left")
    return out


def circular_moments_2d(spectra2d: DataFrame, record: Sequence[str], width_deg: float) -> DataFrame:
    """(frequency, direction) energy to S(f) and alpha/r; directions turn to coming-from."""
    th = F.radians(F.col("direction_deg") + 180.0)
    e = finite("energy") * F.radians(F.lit(width_deg))
    g = spectra2d.groupBy(*record, FREQ).agg(
        F.sum(e).alias("s"),
        F.sum(e * F.cos(th)).alias("a1"), F.sum(e * F.sin(th)).alias("b1"),
        F.sum(e * F.cos(2 * th)).alias("a2"), F.sum(e * F.sin(2 * th)).alias("b2"),
    )
    from ..functions.angles import polar_from_fourier

    s = F.col("s")
    al1, al2, r1, r2 = polar_from_fourier(*[divide(F.col(c), s) for c in ("a1", "b1", "a2", "b2")])
    return g.select(
        *record, FREQ, s.alias(DENSITY), al1.alias("alpha1"), al2.alias("alpha2"), r1.alias("r1"), r2.alias("r2")
    )
