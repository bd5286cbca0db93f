"""Labels from several records or products at once: window-mean spectra, product tables, matched triples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import PI, divide, duration_us, finite, micros
from ..functions.waves import wavenumber
from .align import pair_nearest
from .ordered import RunningMax, RunningMin, RunningSum, ordered

#: Share of the wind-sea energy that must have a measured direction.
MIN_COVERAGE = 0.95


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)


def _peak_period(density: Column, centers: Column) -> Column:
    """Period of the first largest bin."""
    return 1.0 / F.element_at(centers, F.array_position(density, F.array_max(density)).cast("int"))


def _record_sums(records: DataFrame, centers: Sequence[float], widths: Sequence[float], density: str, separation: str, direction: str, spread: str) -> DataFrame:
    """Complete records with the few numbers of their wind sea that windows add up."""
    n = len(centers)
    d, a, r, sep = F.col(density), F.col(direction), F.col(spread), F.col(separation)
    f, w = _numbers(centers), _numbers(widths)
    whole = (F.size(d) == n) & F.forall(d, lambda x: finite(x).isNotNull() & (x >= 0))
    missing = F.array_repeat(F.lit(None).cast("double"), n)
    a, r = F.coalesce(a, missing), F.coalesce(r, missing)
    split = F.coalesce((sep > 0) & (sep < 1), F.lit(False))

    def each(i: Column) -> Column:
        wind = F.when(split & (sep <= f[i]), d[i] * w[i]).otherwise(0.0)
        good = F.coalesce((a[i] >= 0) & (a[i] <= 360) & (r[i] >= 0) & (r[i] <= 1), F.lit(False))
        part = F.when(good, wind).otherwise(0.0)
        return F.struct(wind.alias("all"), part.alias("measured"), (part * F.coalesce(F.when(good, r[i] * F.cos(F.radians(a[i]))), F.lit(0.0))).alias("x"),
                        (part * F.coalesce(F.when(good, r[i] * F.sin(F.radians(a[i]))), F.lit(0.0))).alias("y"))

    rows = records.where(F.coalesce(whole, F.lit(False))).withColumn("_bins", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), each))
    sums = {f"_{k}": _total(F.col(f"_bins.{k}")) for k in ("all", "measured", "x", "y")}
    mass = _total(F.zip_with(d, w, lambda x, y: x * y))
    peak = F.when(mass > 0, _peak_period(d, f))
    return rows.withColumns(sums | {"_peak": peak, "_wind": split & (sep <= F.lit(float(max(centers))))}).drop("_bins")


def _window_totals(
    targets: DataFrame, records: DataFrame, *, window: int, by: Sequence[str], target_id: str, time: str, totals: Sequence[str], low: Sequence[str], high: Sequence[str], limit: int | None,
) -> DataFrame:
    """(target_id, totals, low, high) over the records within ``window`` microseconds (closed) of the rows of a target.

    Time is cut into blocks as long as the window. Around a target lie its whole block, the end of the block before and
    the beginning of the next one: values that run through each block forwards and backwards, so the work grows with the
    rows, not with the pairs, and nothing is taken off a sum again.
    """
    block = F.col(time) - F.pmod(F.col(time), F.lit(window))
    spot = lambda start, way, at: F.struct(start.alias("_block"), F.lit(way).alias("_way"), at.alias("_at"))
    both = F.array(spot(block, 1, F.col(time)), spot(block, -1, -F.col(time)))
    around = F.array(
        spot(block, 1, block + window - 1), spot(block + window, 1, F.col(time) + window), spot(block - window, -1, window - F.col(time))
    )
    values = [*totals, *low, *high]
    passing = records.select(*by, F.lit(0).alias("_side"), F.inline(both), *values)
    asked = targets.select(*by, F.lit(1).alias("_side"), F.inline(around), F.col(target_id).alias("_target"))
    kinds = [(RunningSum, totals), (RunningMin, low), (RunningMax, high)]
    specs = {f"_run{c}": kind(F.col(c)) for kind, names in kinds for c in names}
    rows = ordered(passing.unionByName(asked, allowMissingColumns=True), [*by, "_block", "_way"], ["_at", "_side"], limit=limit, **specs)
    found = rows.where((F.col("_side") == 1) & F.col(f"_run{totals[0]}").isNotNull())
    merged = [f(f"_run{c}").alias(c) for f, names in ((F.sum, totals), (F.min, low), (F.max, high)) for c in names]
    return found.groupBy(F.col("_target").alias(target_id)).agg(*merged)


def window_spectra(
    targets: DataFrame, records: DataFrame, *, centers: Sequence[float], widths: Sequence[float], window: str, by: Sequence[str], target_id: str, record_id: str,
    bands: Sequence[tuple[str, float, float]], target_time: str = "time_utc", record_time: str = "time_utc", density: str = "density", separation: str = "separation_hz",
    direction: str = "direction_deg", spread: str = "r1", depth: str | None = None, min_coverage: float = MIN_COVERAGE, slope_below: float = 0.35, limit: int | None = None,
) -> DataFrame:
    """One row per target from the mean spectrum of the records within ``window`` (closed) of it.

    Records with a missing or negative bin are left out. A bin is summed as a column of its own, and no pairs of
    targets and records are made. Columns: ``n_records``; ``offset_s`` (target minus nearest record, the
    earlier one of two) and its peak period ``tp_nearest_s``; ``tp_window_s`` of the mean spectrum;
    ``tp_range_s`` of the records' peak periods; ``slope``, ``slope_low`` (bins up to ``slope_below``) and, with a
    depth, ``slope_depth``; ``<band>_m2`` of every band [low, high); ``bins_m2``; ``coverage``, the share of
    wind-sea energy with a direction; and, if that reaches ``min_coverage`` and every record separates its wind
    sea, its resultant ``wind_r1`` and ``wind_spread_deg``. A target without records has ``n_records`` 0.
    """
    n, f, w = len(centers), _numbers(centers), _numbers(widths)
    sums = _record_sums(records, centers, widths, density, separation, direction, spread)
    bins = [f"_d{k}" for k in range(n)]
    parts = ["_all", "_measured", "_x", "_y"]
    here = [F.col(c).isNotNull() for c in by]
    known = lambda df, *more: df.where(reduce(Column.__and__, here + [F.col(c).isNotNull() for c in more]))
    span = duration_us(window)
    # Records of one instant are in the same windows.
    instants = known(sums.withColumn("_us", micros(record_time)), "_us").groupBy(*by, "_us").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(density)[k]).alias(c) for k, c in enumerate(bins)], *[F.sum(c).alias(c) for c in parts],
        F.min("_peak").alias("_peak_low"), F.max("_peak").alias("_peak_high"), F.min("_wind").alias("_wind"),
        F.min_by(F.struct(F.col(record_id).alias("id"), F.col("_peak").alias("peak")), F.struct(record_id)).alias("_first"),
    )
    asked = known(targets.select(*by, target_id, target_time, micros(target_time).alias("_us")), target_id, "_us")
    totals = _window_totals(
        asked, instants, window=span, by=by, target_id=target_id, time="_us", totals=["_n", *bins, *parts], low=["_peak_low", "_wind"], high=["_peak_high"], limit=limit
    )
    hits = pair_nearest(
        asked, instants.select(*by, F.timestamp_micros("_us").alias("_at"), "_first"), tolerance=window, by=by, target_time=target_time, reference_time="_at", values=["_first"], limit=limit
    ).where("reference_us is not null")
    off = F.col("time_offset_s")
    nearest = hits.groupBy(target_id).agg(
        F.min_by(F.struct(off.alias("offset_s"), F.col("_first_ref.peak").alias("_peak")), F.struct(F.abs(off), -off, F.col("_first_ref.id"))).alias("_near")
    )
    means = totals.join(nearest, target_id).select(
        target_id, F.col("_n").alias("n_records"), "_near", F.array(*[F.col(c) / F.col("_n") for c in bins]).alias("_mean"),
        (F.col("_peak_high") - F.col("_peak_low")).alias("tp_range_s"), *parts, "_wind",
    )
    energy = F.zip_with("_mean", w, lambda x, y: x * y)
    out = targets.join(means, target_id, "left").withColumn("bins_m2", energy)

    def slope(k: Column, below: float = float("inf")) -> Column:
        terms = F.zip_with(F.zip_with("bins_m2", k, lambda e, x: e * x * x), f, lambda x, c: F.when(c <= below + 1e-8, x).otherwise(0.0))
        return F.sqrt(_total(terms))

    deep = F.array(*[wavenumber(F.lit(float(c))) for c in centers])
    made = {
        "n_records": F.coalesce("n_records", F.lit(0)), "offset_s": F.col("_near.offset_s"), "tp_nearest_s": F.col("_near._peak"),
        "tp_window_s": F.when(_total(F.col("bins_m2")) > 0, _peak_period(F.col("_mean"), f)), "tp_range_s": F.col("tp_range_s"),
        "slope": slope(deep), "slope_low": slope(deep, slope_below),
    }
    if depth:
        at_depth = F.array(*[wavenumber(F.lit(float(c)), F.col(depth)) for c in centers])
        made["slope_depth"] = F.when(F.col(depth).isNotNull(), slope(at_depth))

    def band(low: float, high: float) -> Column:
        return _total(F.zip_with("bins_m2", f, lambda e, c: F.when((c >= low) & (c < high), e).otherwise(0.0)))

    made |= {f"{name}_m2": band(low, high) for name, low, high in bands}
    made["coverage"] = divide(F.col("_measured"), F.col("_all"))
    enough = (F.col("_measured") > 0) & (F.col("_measured") >= min_coverage * F.col("_all")) & F.col("_wind")
    r1 = F.when(enough, F.least(F.lit(1.0), F.hypot("_x", "_y") / F.col("_measured")))
    made |= {"wind_r1": r1, "wind_spread_deg": F.sqrt(2 * (1 - r1)) * (180 / PI)}
    return out.withColumns(made).drop("_near", "_mean", "_all", "_measured", "_x", "_y", "_wind")


def product_table(products: dict[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Products by key as columns; a key that any product has is a row. One shuffle for any number of products.

    Two rows of a product with one key are refused when the result is computed.
    """
    rows = None
    for name, df in products.items():
        part = df.select(*keys, F.lit(name).alias("_product"), F.col(value).alias("_value"))
        rows = part if rows is None else rows.unionByName(part)

    def one(name: str) -> Column:
        own = F.col("_product") == name
        twice = F.raise_error(F.lit(f"two rows of {name} with one key"))
        return F.when(F.count_if(own) > 1, twice.cast(rows.schema["_value"].dataType)).otherwise(F.any_value(F.when(own, F.col("_value")), True)).alias(name)

    return rows.groupBy(*keys).agg(*[one(name) for name in products])


def triple_match(
    first: DataFrame, second: DataFrame, stills: DataFrame, *, by: Sequence[str], stamp: str, window: str, still_id: str, still_time: str,
    excluded: str, sun: str, min_sun: float, limit: int | None = None,
) -> DataFrame:
    """Stamps of two products with the still nearest to the middle of their window.

    One row per stamp that either product has: the still, whether it lies in [stamp, stamp + window), and
    ``excluded_by``, the first leg that failed: ``no_first``, ``no_second``, ``no_still``, ``outside``, the still's
    own reason, ``low_sun``; NULL for a matched triple.
    """
    w = duration_us(window)
    a, b = (d.select(*by, stamp).distinct().withColumn(name, F.lit(True)) for d, name in ((first, "_first"), (second, "_second")))
    both = a.join(b, [*by, stamp], "full").withColumn("_centre", F.timestamp_micros(micros(stamp) + w // 2))
    hit = pair_nearest(
        both, stills.select(*by, still_id, F.col(still_time).alias("_still"), excluded, sun), by=by, tolerance=None, target_time="_centre", reference_time="_still",
        values=[still_id, "_still", excluded, sun], reference_tie=still_id, limit=limit,
    )
    at = micros("_still_ref") - micros(stamp)
    inside = F.coalesce((at >= 0) & (at < w), F.lit(False))
    reason = (
        F.when(F.col("_first").isNull(), "no_first").when(F.col("_second").isNull(), "no_second").when(F.col(f"{still_id}_ref").isNull(), "no_still")
        .when(~inside, "outside").when(F.coalesce(F.col(f"{excluded}_ref"), F.lit("")) != "", F.col(f"{excluded}_ref"))
        .when(~F.coalesce(F.col(f"{sun}_ref") >= min_sun, F.lit(False)), "low_sun")
    )
    return hit.select(*by, stamp, F.col(f"{still_id}_ref").alias(still_id), F.col("_still_ref").alias(still_time), inside.alias("inside"), reason.alias("excluded_by"))


def leg_counts(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stamps of both products, and how many have a still inside, a usable one, and daylight."""
    e = F.col("excluded_by")
    both = e.isNull() | ~e.isin("no_first", "no_second")
    used = F.col("inside") & both & (e.isNull() | (e == "low_sun"))
    return matched.groupBy(*by).agg(
        F.count_if(both).alias("stamps"), F.count_if(both & F.col("inside")).alias("still_inside"), F.count_if(used).alias("paired"), F.count_if(e.isNull()).alias("daylight")
    )


def disk_and_ledgers(disk: DataFrame, ledger: DataFrame, *, name: str = "name", path: str = "path") -> DataFrame:
    """Every file name that is on disk or in a ledger.

    ``ledger``: url, sha256, size_bytes, retrieved_at, status, ledger. A name that was downloaded keeps its
    latest checksum row, one that never was its latest status. ``ledgers`` are those with a checksum of it, in
    order of their first one, and ``sha256_differ`` says whether they hold different ones.
    """
    rows = ledger.withColumns({name: F.element_at(F.split("url", "/"), -1), "_got": F.col("sha256").isNotNull()})
    each = rows.groupBy(name, "ledger").agg(
        F.max_by(F.struct("url", "sha256", "size_bytes", "retrieved_at", "status"), F.struct("_got", "retrieved_at", "url")).alias("_row"),
        F.min(F.when(F.col("_got"), F.col("retrieved_at"))).alias("_since"),
        F.min("sha256").alias("_low"), F.max("sha256").alias("_high"),
    )
    entry = F.when(F.col("_since").isNotNull(), F.struct(F.col("_since").alias("since"), F.col("ledger").alias("ledger")))
    one = each.groupBy(name).agg(
        F.max_by("_row", F.struct(F.col("_row.sha256").isNotNull(), F.col("_row.retrieved_at"), F.col("ledger"))).alias("_row"),
        F.array_sort(F.collect_list(entry)).alias("_ledgers"),
        F.coalesce(F.min("_low") != F.max("_high"), F.lit(False)).alias("sha256_differ"),
    )
    named = F.when(F.size("_ledgers") > 0, F.array_join(F.transform("_ledgers", lambda x: x["ledger"]), ","))
    one = one.select(name, "_row.*", named.alias("ledgers"), "sha256_differ")
    both = disk.select(name, path).join(one, name, "full")
    return both.withColumns({"on_disk": F.col(path).isNotNull(), "in_ledger": F.col("status").isNotNull(), "sha256_differ": F.coalesce("sha256_differ", F.lit(False))})
