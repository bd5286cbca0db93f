"""Measures of images that arrive as grey-block arrays, and choices based on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import DAY_US, HOUR_US, divide, finite, micros
from ..functions.geo import solar_position
from .ordered import Prev, ordered
from .quantiles import median, quantiles, spearman
from .skew import salted_join


def view_statistics(blocks: str | Column, n_views: int) -> Column:
    """Mean and population deviation of each of ``n_views`` equal parts of a block array.

    An array that doesn't divide into equal parts can't be read: NULL.
    """
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    width = F.floor(F.size(b) / n_views).cast("int")

    def one(i: Column) -> Column:
        part = F.slice(b, i * width + 1, F.greatest(width, F.lit(1)))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("n"))

        def add(acc: Column, x: Column) -> Column:
            x = x.cast("double")
            return F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q"), (acc["n"] + 1).alias("n"))

        def finish(acc: Column) -> Column:
            mean = acc["s"] / acc["n"]
            var = F.greatest(acc["q"] / acc["n"] - mean * mean, F.lit(0.0))
            return F.struct(mean.alias("mean"), F.sqrt(var).alias("std"))

        return F.aggregate(part, zero, add, finish)

    return F.when((F.size(b) > 0) & (F.size(b) % n_views == 0), F.transform(F.sequence(F.lit(0), F.lit(n_views - 1)), one))


def usable_views(stats: str | Column, min_mean: float, min_std: float) -> Column:
    """Number of views bright and varied enough; a missing value is not usable."""
    s = F.col(stats) if isinstance(stats, str) else stats
    ok = F.filter(s, lambda v: F.coalesce((v["mean"] >= min_mean) & (v["std"] >= min_std), F.lit(False)))
    return F.size(ok)


def difference_hash(blocks: str | Column, size: int = 8) -> Column:
    """64 bits: whether each block is darker than its right neighbour, first comparison highest.

    ``blocks`` holds ``size`` rows of ``size + 1`` block means.
    """
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    bits = []
    for k in range(size * size):
        r, c = divmod(k, size)
        i = r * (size + 1) + c
        power = 1 << (size * size - 1 - k)
        bits.append(F.when(F.get(b, F.lit(i + 1)) > F.get(b, F.lit(i)), F.lit(power - (1 << 64) if power >> 63 else power)).otherwise(F.lit(0)).cast("bigint"))
    out = bits[0]
    for x in bits[1:]:
        out = out.bitwiseOR(x)
    return out


def in_daylight(df: DataFrame, time: str, lat: str, lon: str, min_elevation: float) -> DataFrame:
    elevation, _ = solar_position(time, lat, lon)
    return df.withColumn("sun_elevation_deg", elevation).where(F.col("sun_elevation_deg") >= min_elevation)


def daylight_means(df: DataFrame, value: str, time: str, lat: str, lon: str, by: Sequence[str], day: Column) -> DataFrame:
    """Daily mean and count over daylight rows."""
    rows = in_daylight(df, time, lat, lon, 0.0)
    return rows.groupBy(*by, day.alias("local_day")).agg(F.avg(value).alias("mean"), F.count(value).alias("n_records"))


def light_contradicts_time(brightness: Column, elevation: Column, dark: float, bright: float) -> Column:
    """A bright image in the night or a dark one in full daylight."""
    return ((brightness >= bright) & (elevation < -6)) | ((brightness <= dark) & (elevation > 6))


def clock_shift_scan(
    df: DataFrame, *, time: str, brightness: str, lat: str, lon: str, shifts_min: Sequence[int], threshold: float, by: Sequence[str],
    elevations: Sequence[float] = (-10.0, -8.0, -6.0, -4.0, -2.0, 0.0, 2.0),
) -> DataFrame:
    """Per key: the clock shift with the fewest images whose brightness disagrees with the sun.

    Day begins at each of ``elevations`` in turn; the best shift over all of them is reported with the
    range of the shifts that are best for one of them. The sun is computed once for each shift.
    """
    moved = df.select("*", F.explode(F.array(*[F.lit(s) for s in shifts_min])).alias("shift_min"))
    at = F.timestamp_micros(micros(time) + F.col("shift_min").cast("bigint") * 60_000_000)
    elevation, _ = solar_position(at, lat, lon)
    lit = moved.select(*by, "shift_min", (F.col(brightness) >= threshold).alias("_bright"), elevation.alias("_sun"))
    wrong = [F.struct(F.lit(e).alias("elevation"), F.count_if(F.col("_bright") != (F.col("_sun") > e)).alias("wrong")) for e in elevations]
    counts = lit.groupBy(*by, "shift_min").agg(F.array(*wrong).alias("w"), F.count(F.lit(1)).alias("n"))
    counts = counts.select(*by, "shift_min", "n", F.inline("w"))
    order = F.struct("wrong", F.abs("shift_min"), "shift_min")
    each = counts.groupBy(*by, "elevation").agg(F.min_by(F.struct("shift_min", "wrong", "n"), order).alias("b"))
    first = F.min_by("b", F.struct("b.wrong", F.abs("b.shift_min"), "b.shift_min", "elevation"))
    out = each.groupBy(*by).agg(first.alias("b"), F.min("b.shift_min").alias("lowest_shift"), F.max("b.shift_min").alias("highest_shift"))
    return out.select(*by, "b.shift_min", "b.wrong", "b.n", "lowest_shift", "highest_shift")


def rank_interleave(df: DataFrame, strata: Sequence[str], within: str, order: Sequence[Column], site: str, day: str, apart_days: int) -> DataFrame:
    """Dates in turns from the queues of all strata, one for each site and spell, with their ``rank`` at the site.

    In a stratum the best of every ``within`` group come first, then the second best, and so on; that is
    the stratum's queue. Queues are read abreast, and a date is kept if it is more than ``apart_days`` from
    every date kept at its site. This last step is sequential over at most one row per calendar day of a site.
    """
    import pandas as pd

    from .ordered import ordered, position

    named = df.withColumns({f"_o{i}": o for i, o in enumerate(order)})
    ranked = ordered(named, [*strata, within], [f"_o{i}" for i in range(len(order))], _k=position())
    queued = ordered(ranked.drop(*[f"_o{i}" for i in range(len(order))]), list(strata), ["_k", within], rank=position()).drop("_k")
    columns = ["rank", *strata, day]

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(columns)
        days = pd.to_datetime(rows[day]).dt.normalize().astype("datetime64[s]").astype("int64") // 86_400
        near: set[int] = set()
        chosen = []
        for d in days:
            chosen.append(d not in near)
            if chosen[-1]:
                near.update(range(d - apart_days, d + apart_days + 1))
        rows = rows[chosen]
        return rows.assign(rank=range(1, len(rows) + 1))

    return queued.groupBy(site).applyInPandas(keep, queued.schema)


def since_first(df: DataFrame, site: str, time: str, output: str = "age_days") -> DataFrame:
    """Days since the first row of the site."""
    first = df.groupBy(site).agg(F.min(micros(time)).alias("_t0"))
    return salted_join(df, first, [site], how="left").withColumn(output, (micros(time) - F.col("_t0")) / DAY_US).drop("_t0")


def motion_features(df: DataFrame, sample: str, view: Sequence[str], value: str, min_views: int = 3) -> DataFrame:
    """Mean and deviation per sample of values with the median of their view removed."""
    med = quantiles(df, view, value, {"_med": 0.5})
    rows = salted_join(df, med, view, how="left").withColumn("_r", F.col(value) - F.col("_med"))
    n = F.count("_r")
    return rows.groupBy(sample).agg(
        F.when(n >= min_views, F.avg("_r")).alias("mean"), F.when(n >= min_views, F.stddev_pop("_r")).alias("std")
    )


def third_gap(df: DataFrame, by: str, rank_by: str, flag: str, tie: str, min_rows: int = 30) -> DataFrame:
    """Share of ``flag`` in the top third minus the bottom third within groups, weighted by size (one row)."""
    from .ordered import ordered, position

    ranked = ordered(df, [by], [rank_by, tie], _k=position())
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = salted_join(ranked, sizes.where(F.col("_n") >= min_rows), [by], how="left").where("_n is not null")
    x = F.col("_k") / F.col("_n")
    f = F.col(flag).cast("double")
    g = ranked.groupBy(by).agg(
        (F.avg(F.when(x > 2 / 3, f)) - F.avg(F.when(x <= 1 / 3, f))).alias("gap"), F.max("_n").alias("n")
    )
    return g.agg(divide(F.sum(F.col("gap") * F.col("n")), F.sum("n")).alias("gap"), F.count(F.lit(1)).alias("n_groups"))


def hourly_changes(
    df: DataFrame, *, by: Sequence[str], time: str, value: str, height: str, local_time: str | None = None, low_h: float = 0.75, high_h: float = 1.25, limit: int | None = None
) -> DataFrame:
    """(by..., pairs, rho): rank correlation of changes between consecutive rows about an hour apart.

    From the change of ``value`` the median change of its hour of day and month is removed, which takes out the
    light; ``height`` is known at the rows' times. Medians and ranks are exact and split where a station is hot.
    """
    local = F.col(local_time or time)
    rows = df.select(*by, micros(time).alias("_us"), F.hour(local).alias("_hour"), F.month(local).alias("_month"), finite(value).alias("_v"), finite(height).alias("_h"))
    seen = ordered(rows, list(by), ["_us", "_v", "_h"], limit=limit, _us0=Prev(F.col("_us")), _v0=Prev(F.col("_v")), _h0=Prev(F.col("_h")))
    gap = (F.col("_us") - F.col("_us0")) / HOUR_US
    pairs = seen.where((gap > low_h) & (gap < high_h)).select(*by, "_hour", "_month", (F.col("_v") - F.col("_v0")).alias("_dv"), (F.col("_h") - F.col("_h0")).alias("_dh"))
    cell = [*by, "_hour", "_month"]
    usual = median(pairs, cell, "_dv", "_usual", limit=limit)
    rest = salted_join(pairs, usual, cell, how="left", limit=limit).withColumn("_rest", F.col("_dv") - F.col("_usual"))
    whole = rest.where("_rest is not null and _dh is not null")
    counts = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"))
    return counts.join(spearman(whole, list(by), "_rest", "_dh", output="rho", limit=limit), list(by))
