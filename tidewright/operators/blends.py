"""Combining a forecast with a second estimate: weights fitted on calibration rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import DAY_US, clip, divide, micros
from ..functions.stats import seeded_hash
from ..session import materialise
from .ordered import ordered, position
from .quantiles import quantiles, quantiles_of
from .skew import salted_join

QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
TERCILES = {"lo": 1.0 / 3.0, "hi": 2.0 / 3.0}


def cut_index(value: str, cuts: Sequence[str], *, right: bool = False) -> Column:
    """Number of cut columns below the value (at or below it with ``right``)."""
    v = F.col(value)
    return sum(((v >= F.col(c)) if right else (v > F.col(c))).cast("int") for c in cuts)


def variance_weights(
    cal: DataFrame, by: Sequence[str], observed: str, forecast: str, camera: str, total: str, min_bin: int = 100
) -> DataFrame:
    """Mean squared energy residuals of both inputs per quartile of the forecast total.

    One row per (by, bin) with the three cuts; a bin below ``min_bin`` rows takes the pooled
    residuals. Four rows per fold, so the table may be broadcast when ``by`` is a fold.
    """
    # The calibration columns are read by the cuts, the bins and the pooled values.
    cal = materialise(cal.select(*dict.fromkeys([*by, observed, forecast, camera, total])))
    cuts = quantiles(cal, by, total, QUARTILES)
    rows = salted_join(cal, cuts, by, how="left")
    y2 = F.pow(F.col(observed), 2)
    rc = F.pow(F.pow(F.col(camera), 2) - y2, 2)
    rm = F.pow(F.pow(F.col(forecast), 2) - y2, 2)
    binned = rows.withColumn("bin", cut_index(total, list(QUARTILES)))
    per_bin = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(rc).alias("_c"), F.avg(rm).alias("_m")
    )
    pooled = binned.groupBy(*by).agg(F.avg(rc).alias("_pc"), F.avg(rm).alias("_pm"))
    grid = cuts.withColumn("bin", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    out = grid.join(per_bin, [*by, "bin"], "left").join(pooled, list(by))
    enough = F.coalesce(F.col("_n") >= min_bin, F.lit(False))
    return out.select(
        *by, *QUARTILES, "bin",
        F.when(enough, F.col("_c")).otherwise(F.col("_pc")).alias("v_camera"),
        F.when(enough, F.col("_m")).otherwise(F.col("_pm")).alias("v_forecast"),
    )


def apply_variance_weights(
    df: DataFrame, weights: DataFrame, by: Sequence[str], forecast: str, camera: str, total: str
) -> DataFrame:
    """``blend_total`` and ``blend``: energies combined by inverse mean squared residual."""
    weights = materialise(weights)
    cuts = weights.where("bin = 0").select(*by, *QUARTILES)
    rows = salted_join(df, cuts, by, how="left").withColumn("bin", cut_index(total, list(QUARTILES)))
    rows = salted_join(rows.drop(*QUARTILES), weights.drop(*QUARTILES), [*by, "bin"], how="left")
    c2, w2, t2 = (F.pow(F.col(c), 2) for c in (camera, forecast, total))
    vc, vm = F.col("v_camera"), F.col("v_forecast")
    e = (c2 / vc + w2 / vm) / (1 / vc + 1 / vm)
    return rows.withColumns(
        {"blend": F.sqrt(e), "blend_total": F.sqrt(F.greatest(t2 - w2, F.lit(0.0)) + e)}
    ).drop("bin", "v_camera", "v_forecast")


def reliability_weights(
    cal: DataFrame, by: Sequence[str], observed: str, forecast: str, disagreement: str, features: Sequence[str],
    penalty_rows: float = 100.0,
) -> DataFrame:
    """Shrunken weights in 3^d tercile cells: one row per (by, cell), cuts included.

    A cell weight is (cross + p c) / (square + p) with the constant weight c and
    p = ``penalty_rows`` mean squared disagreements, clipped to [0, 1].
    """
    return reliability_arms(cal, by, observed, forecast, disagreement, {"cells": features}, penalty_rows)["cells"]


def reliability_arms(
    cal: DataFrame, by: Sequence[str], observed: str, forecast: str, disagreement: str, arms: Mapping[str, Sequence[str]],
    penalty_rows: float = 100.0,
) -> dict[str, DataFrame]:
    """:func:`reliability_weights` for each arm's features.

    The cuts of a feature are made once, and one pass sums the rows in the cells of all features; an arm adds these up.
    """
    every = list(dict.fromkeys(f for features in arms.values() for f in features))
    cal = materialise(cal.select(*dict.fromkeys([*by, observed, forecast, disagreement, *every])))
    cuts = quantiles_of(cal, by, {f: {f"{f}_{k}": p for k, p in TERCILES.items()} for f in every})
    cuts = materialise(cuts)  # read for the cells and for the grid
    thirds = {f: f"_third{i}" for i, f in enumerate(every)}
    rows = salted_join(cal, cuts, by, how="left").withColumns({thirds[f]: third(f) for f in every})
    d, r = F.col(disagreement), F.col(observed) - F.col(forecast)
    sums = rows.groupBy(*by, *thirds.values()).agg(F.count(F.lit(1)).alias("_n"), F.sum(d * r).alias("_x"), F.sum(d * d).alias("_s"))
    sums = materialise(sums)
    whole = sums.groupBy(*by).agg(F.sum("_n").alias("_tn"), F.sum("_x").alias("_tx"), F.sum("_s").alias("_ts"))
    constant = F.coalesce(clip(divide(F.col("_tx"), F.col("_ts")), 0.0, 1.0), F.lit(0.0))
    p = penalty_rows * F.col("_ts") / F.col("_tn")
    x, s = F.coalesce("_x", F.lit(0.0)), F.coalesce("_s", F.lit(0.0))
    w = F.coalesce(divide(x + p * F.col("constant"), s + p), F.col("constant"))
    out = {}
    for arm, features in arms.items():
        names = [f"{f}_{k}" for f in features for k in TERCILES]
        cell = _base_three([F.col(thirds[f]) for f in features]).alias("cell")
        cells = sums.groupBy(*by, cell).agg(F.sum("_n").alias("_n"), F.sum("_x").alias("_x"), F.sum("_s").alias("_s"))
        grid = cuts.select(*by, *names, F.explode(F.array(*[F.lit(i) for i in range(3 ** len(features))])).alias("cell"))
        found = grid.join(cells, [*by, "cell"], "left").join(whole, list(by)).withColumn("constant", constant)
        out[arm] = found.select(
            *by, *names, "cell", clip(w, 0.0, 1.0).alias("weight"), "constant",
            F.coalesce("_n", F.lit(0)).cast("bigint").alias("rows"),
        )
    return out


def third(feature: str) -> Column:
    """0, 1 or 2: the part between the feature's terciles."""
    return cut_index(feature, [f"{feature}_{k}" for k in TERCILES], right=True)


def _base_three(digits: Sequence[Column]) -> Column:
    out = F.lit(0)
    for d in digits:
        out = out * 3 + d
    return out


def cell_index(features: Sequence[str]) -> Column:
    return _base_three([third(f) for f in features])


def apply_reliability(
    df: DataFrame, weights: DataFrame, by: Sequence[str], forecast: str, disagreement: str, features: Sequence[str]
) -> DataFrame:
    """``reliability`` and ``constant_blend`` by the weights of each row's cell."""
    names = [f"{f}_{k}" for f in features for k in TERCILES]
    # One row for each key: its cuts, and the weights of its 3^d cells in order.
    cells = F.array_sort(F.collect_list(F.struct("cell", "weight", "constant"))).alias("_cells")
    packed = weights.groupBy(*by).agg(*[F.first(n).alias(n) for n in names], cells)
    rows = salted_join(df, packed, by, how="left").withColumn("_cell", F.get("_cells", cell_index(features)))
    f, d = F.col(forecast), F.col(disagreement)
    return rows.withColumns(
        {"weight": F.col("_cell.weight"), "constant": F.col("_cell.constant"), "cell": F.col("_cell.cell")}
    ).withColumns(
        {"reliability": f + F.col("weight") * d, "constant_blend": f + F.col("constant") * d}
    ).drop(*names, "_cells", "_cell")


def degraded_control(
    df: DataFrame, within: Sequence[str], row_id: str, columns: Sequence[str], seed: int = 0
) -> DataFrame:
    """The given columns permuted inside each cell: the k-th row by id takes the k-th by hash.

    Both numberings are ordered scans, so a cell may hold any number of rows.
    """
    by_id = ordered(df, within, [row_id], _k=position())
    by_hash = ordered(
        df.select(*within, row_id, *columns).withColumn("_h", seeded_hash(seed, row_id)), within, ["_h", row_id],
        _k=position(),
    ).select(*within, "_k", F.col(row_id).alias("donor"), *[F.col(c).alias(f"{c}_degraded") for c in columns])
    return by_id.join(by_hash, [*within, "_k"]).drop("_k")


def local_calibration(
    df: DataFrame, *, station: str, time: str, observed: str, forecast: str, disagreement: str, weight: str,
    mean_d2: str, fit_days: float = 7, later_days: float = 9, min_rows: int = 24, penalty_rows: float = 50.0,
) -> DataFrame:
    """Each station's weight shifted by its first days, applied after an embargo.

    The offset is d.(observed - blend) / (d.d + p mean_d2) over the first ``fit_days``; stations
    with fewer than ``min_rows`` early rows are left out, as their offset is not known; ``calibration_coverage``
    lists them. ``mean_d2`` must be one value for each station.
    """
    if df.groupBy(station).agg(F.count_distinct(mean_d2).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"a station has several values of {mean_d2}")
    us = micros(time)
    d, blend = F.col(disagreement), F.col(forecast) + F.col(weight) * F.col(disagreement)
    starts = df.groupBy(station).agg(F.min(us).alias("_t0"))
    rows = salted_join(df, starts, [station], how="left").withColumn("_age", (us - F.col("_t0")) / DAY_US)
    early = F.col("_age") < fit_days
    fit = rows.groupBy(station).agg(
        F.sum(F.when(early, d * (F.col(observed) - blend))).alias("_x"),
        F.sum(F.when(early, d * d)).alias("_s"),
        F.count_if(early).alias("_n"),
        F.min(mean_d2).alias("_m"),
    )
    offset = F.coalesce(divide(F.col("_x"), F.col("_s") + penalty_rows * F.col("_m")), F.lit(0.0))
    fit = fit.where(F.col("_n") >= min_rows).select(station, offset.alias("offset"))
    later = rows.where(F.col("_age") >= later_days).drop("_t0", "_age")
    out = salted_join(later, fit, [station], how="left").where("offset is not null")
    shifted = clip(F.col(weight) + F.col("offset"), 0.0, 1.0)
    return out.withColumn("local_blend", F.col(forecast) + shifted * d)


def calibration_coverage(df: DataFrame, *, station: str, time: str, fit_days: float = 7, later_days: float = 9, min_rows: int = 24) -> DataFrame:
    """Each station's rows in its first days and after the embargo, and whether it can be calibrated."""
    us = micros(time)
    starts = df.groupBy(station).agg(F.min(us).alias("_t0"))
    age = (us - F.col("_t0")) / DAY_US
    rows = salted_join(df.select(station, time), starts, [station], how="left")
    out = rows.groupBy(station).agg(F.count_if(age < fit_days).alias("n_early"), F.count_if(age >= later_days).alias("n_later"))
    return out.withColumn("calibrated", F.col("n_early") >= min_rows)


def gated_swap(
    df: DataFrame, coefficients: DataFrame, by: Sequence[str], gate: Sequence[str], *, total: str, forecast: str, camera: str
) -> DataFrame:
    """Energy swap with a fitted logistic gate: coefficients ``b0, b1, ...`` per fold are given."""
    rows = salted_join(df, coefficients, by, how="left")
    z = F.col("b0")
    for i, g in enumerate(gate):
        z = z + F.col(f"b{i + 1}") * F.col(g)
    w = 1 / (1 + F.exp(-z))
    c2, w2, t2 = (F.pow(F.col(c), 2) for c in (camera, forecast, total))
    e = w * c2 + (1 - w) * w2
    return rows.withColumns(
        {"gate": w, "swap": F.sqrt(e), "swap_total": F.sqrt(F.greatest(t2 - w2, F.lit(0.0)) + e)}
    )
