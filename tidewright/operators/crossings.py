"""Individual waves: zero crossings of an elevation series and statistics of crossing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import divide
from .ordered import Next, Prev, RunningSum, largest_group, ordered, position
from .skew import salted_join


def detrend(df: DataFrame, record: Sequence[str], time: str, value: str, how: str, limit=None) -> DataFrame:
    """Remove the record mean, a least-squares line, or nothing; adds ``_eta``."""
    v, t = F.col(value), F.col(time)
    if how == "none":
        return df.withColumn("_eta", v.cast("double"))
    if how == "mean":
        fit = df.groupBy(*record).agg(F.avg(v).alias("_a"), F.lit(0.0).alias("_b"))
    elif how == "linear":
        fit = df.groupBy(*record).agg(F.regr_intercept(v, t).alias("_a"), F.regr_slope(v, t).alias("_b"))
    else:
        raise ValueError(f"unknown detrend {how!r}")
    joined = salted_join(df, fit, record, how="left", limit=limit)
    return joined.withColumn("_eta", v - (F.col("_a") + F.col("_b") * t)).drop("_a", "_b")


def incomplete_records(df: DataFrame, record: Sequence[str], value: str) -> DataFrame:
    """Records with missing samples and how many; ``zero_crossing_waves`` leaves them out as a whole."""
    missing = F.col(value).isNull() | F.isnan(F.col(value).cast("double"))
    return df.groupBy(*record).agg(F.count_if(missing).alias("n_missing")).where("n_missing > 0")


def zero_crossing_waves(
    df: DataFrame,
    record: Sequence[str],
    *,
    time: str,
    value: str,
    crossing: str = "up",
    how: str = "mean",
    limit=None,
) -> DataFrame:
    """One row per complete wave: height, period, crest, trough and interpolated start.

    ``time`` is in seconds. A wave runs from one crossing to the next; the part after the last
    crossing is not complete. A record with a missing sample has no waves; see ``incomplete_records``.
    """
    whole = df.join(incomplete_records(df, record, value), list(record), "left_anti")
    base = detrend(whole, record, time, value, how, limit).select(
        *record, F.col(time).cast("double").alias("_t"), "_eta"
    )
    largest = largest_group(base, record)
    seen = ordered(base, record, ["_t"], limit=limit, largest=largest, _p=Prev(F.struct("_t", "_eta")))
    a, b = F.col("_p._eta"), F.col("_eta")
    hit = (a < 0) & (b >= 0) if crossing == "up" else (a > 0) & (b <= 0)
    hit = F.coalesce(hit, F.lit(False))
    start = F.col("_p._t") + a / (a - b) * (F.col("_t") - F.col("_p._t"))
    seen = seen.withColumns({"_hit": hit.cast("bigint"), "_start": F.when(hit, start)}).drop("_p")
    seen = ordered(seen, record, ["_t"], limit=limit, largest=largest, wave=RunningSum(F.col("_hit")))
    waves = (
        seen.where("wave > 0")
        .groupBy(*record, "wave")
        .agg(F.max("_start").alias("start_s"), F.max("_eta").alias("_hi"), F.min("_eta").alias("_lo"))
    )
    # A record has fewer waves than samples.
    waves = ordered(waves, record, ["wave"], limit=limit, largest=largest, _end=Next(F.col("start_s"))).where("_end is not null")
    crest, trough = F.greatest("_hi", F.lit(0.0)), F.greatest(-F.col("_lo"), F.lit(0.0))
    return waves.select(
        *record,
        "wave",
        "start_s",
        (F.col("_end") - F.col("start_s")).alias("period"),
        crest.alias("crest"),
        trough.alias("trough"),
        (crest + trough).alias("height"),
    )


def wave_summary(waves: DataFrame, record: Sequence[str], rule: str = "floor", limit=None) -> DataFrame:
    """H1/3, H1/10, Hmax, Hmean, Hrms, Tz, T1/3 and the period of the highest wave."""
    totals = waves.groupBy(*record).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered(
        waves.withColumn("_minus", -F.col("height")), record, ["_minus", "wave"], limit=limit, _rank=position()
    )
    ranked = salted_join(ranked, totals, record, how="left", limit=limit)
    cut = F.floor if rule == "floor" else F.bround

    def top(share: float):
        return F.col("_rank") <= cut(F.col("_n") * F.lit(share))

    third, tenth = top(1.0 / 3.0), top(0.1)
    h, t = F.col("height"), F.col("period")
    return ranked.groupBy(*record).agg(
        F.count(F.lit(1)).alias("n_waves"),
        F.avg(F.when(third, h)).alias("h_one_third"),
        F.avg(F.when(tenth, h)).alias("h_one_tenth"),
        F.max(h).alias("h_max"),
        F.avg(h).alias("h_mean"),
        F.sqrt(F.avg(h * h)).alias("h_rms"),
        F.avg(t).alias("t_z"),
        F.avg(F.when(third, t)).alias("t_one_third"),
        F.min_by(t, "_rank").alias("t_h_max"),
    )


def crossing_statistics(
    crossings: DataFrame,
    record: Sequence[str],
    *,
    order: str,
    start_s: float | None = None,
    end_s: float | None = None,
    min_waves: int = 20,
    limit=None,
) -> DataFrame:
    """Height and period statistics of a table of signed crossings, for two flag sets.

    Columns of ``crossings``: ``bound_start, bound_end`` (seconds), ``peak, height, period,
    flag``. A wave is complete when an upward excursion is followed at once by a downward one.
    """
    fields = ("bound_start", "bound_end", "peak", "height", "period", "flag")
    seen = ordered(crossings, record, [order], limit=limit, _q=Next(F.struct(*fields)))
    q = {f: F.col(f"_q.{f}") for f in fields}
    ok = (
        (F.col("peak") > 0) & (q["peak"] < 0) & (q["peak"] > -100)
        & (F.abs(F.col("bound_end") - q["bound_start"]) < 0.002)
        & (F.col("height") > 0) & (F.col("height") <= 40) & (F.col("period") > 0)
    )
    if start_s is not None:
        ok = ok & (F.col("bound_start") >= start_s)
    if end_s is not None:
        ok = ok & (q["bound_end"] <= end_s)
    out = crossings.select(*record).distinct()
    for name, flags in (("good", [1]), ("incl_unevaluated", [1, 2])):
        keep = seen.where(ok & F.col("flag").isin(flags) & q["flag"].isin(flags))
        keep = keep.select(*record, order, "height", "period", (-F.col("height")).alias("_minus"))
        totals = keep.groupBy(*record).agg(F.count(F.lit(1)).alias("_n"))
        ranked = ordered(keep, record, ["_minus", order], limit=limit, _rank=position())
        ranked = salted_join(ranked, totals, record, how="left", limit=limit)
        n, r, h = F.col("_n"), F.col("_rank"), F.col("height")
        many = F.max(n) >= min_waves
        stats = ranked.groupBy(*record).agg(
            F.max(n).alias(f"{name}_wave_count"),
            F.when(many, F.avg(h)).alias(f"{name}_mean_height_m"),
            F.when(many, F.avg(F.when(r <= F.floor((n + 2) / 3), h))).alias(f"{name}_h_third_m"),
            F.when(many, F.avg(F.when(r <= F.floor((n + 9) / 10), h))).alias(f"{name}_h_tenth_m"),
            F.when(many, F.avg("period")).alias(f"{name}_tz_s"),
        )
        out = out.join(stats, list(record), "left")
    return out.fillna(0, [f"{n}_wave_count" for n in ("good", "incl_unevaluated")])


def energy_period(spectra: DataFrame, record: Sequence[str]) -> DataFrame:
    """sum(e/f) / sum(e) of band energies per record."""
    return spectra.groupBy(*record).agg(
        divide(F.sum(F.col("energy") / F.col("frequency_hz")), F.sum("energy")).alias("energy_period_s")
    )
