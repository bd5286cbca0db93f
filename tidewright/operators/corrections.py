"""Corrections on top of a first estimate: residual ridge, spectral bands, weights carried over to held-out folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.base import ColumnLike, col, finite, micros
from ..session import materialise
from . import blends, fits
from .assembly import refuse
from .skew import salted_join

FLOOR = 1e-8


def wind_features(speed: ColumnLike, gust: ColumnLike) -> dict[str, Column]:
    """Speed, gust, their squares and their product, as columns by name."""
    s, g = col(speed), col(gust)
    return {"wind_speed": s, "wind_gust": g, "wind_speed2": s * s, "wind_gust2": g * g, "wind_speed_gust": s * g}


def residual_ridge(
    df: DataFrame, features: Sequence[str], target: str, *, nowcast: str, train_nowcast: str, role: str, by: Sequence[str],
    alphas: Sequence[float], output: str = "prediction",
) -> DataFrame:
    """``nowcast`` plus a ridge per key (a camera) on what it leaves over, and the chosen ``alpha``.

    The penalty is chosen on val rows by the residual of ``train_nowcast``, which has seen train rows only; the
    model is then fitted on train and val rows by the residual of ``nowcast``. A row of a key that has no model, or
    with a missing feature, keeps its nowcast. Keys must not be NULL.
    """
    y = finite(target)
    rows = materialise(df.withColumns({"_r0": y - finite(train_nowcast), "_r": y - finite(nowcast)}))
    chosen = fits.ridge_select_alpha(rows, features, "_r0", role=role, alphas=alphas, by=by).select(*by, "alpha")
    known = rows.where(F.col(role).isin("train", "val"))
    sums = known.groupBy(*by).agg(*[v.alias(k) for k, v in fits.gram_sums(features, "_r").items()])
    models = fits.solve(sums.join(chosen, list(by)), F.col("alpha")).select(*by, "alpha", "model")
    joined = salted_join(rows, models, by, how="left")
    value = F.coalesce(finite(nowcast) + fits.linear_value(features), finite(nowcast))
    return joined.withColumn(output, value).drop("_r0", "_r", "model")


def band_corrections(
    df: DataFrame, bands: Mapping[str, tuple[str, str]], features: Sequence[str], *, row_id: str, complete: Column, train: Column, test: Column, alpha: float = 1.0
) -> DataFrame:
    """(row_id, band, prior, corrected) of the test rows: prior band energies times a positive factor.

    ``bands`` names the columns of true and prior energy of each band. The factor is the exponential of a ridge on the
    logarithm of true over prior, with the features and the prior's logarithm. Rows that aren't ``complete`` or have no
    positive prior take no part; a band with fewer than two rows to fit has no rows. All bands are fitted in one pass.
    """
    cells = [F.struct(F.lit(b).alias("band"), finite(t).alias("_true"), finite(p).alias("prior")) for b, (t, p) in bands.items()]
    flags = [F.coalesce(c, F.lit(False)).alias(n) for c, n in ((train, "_train"), (test, "_test"))]
    long = df.where(complete).select(row_id, *features, *flags, F.inline(F.array(*cells))).where("prior > 0")
    floored = lambda c: F.greatest(F.col(c), F.lit(FLOOR))
    long = long.withColumns({"_lp": F.ln(floored("prior")), "_log": F.ln(floored("_true") / F.col("prior"))})
    inputs = [*features, "_lp"]
    sums = long.where("_train and _true is not null").groupBy("band").agg(*[v.alias(k) for k, v in fits.gram_sums(inputs, "_log").items()])
    models = fits.solve(sums.where("n >= 2"), alpha).select("band", "model")
    # One row for each band.
    rows = long.where("_test").join(F.broadcast(models), "band")
    return rows.select(row_id, "band", "prior", (F.col("prior") * F.exp(fits.linear_value(inputs))).alias("corrected"))


def _calibration(inner: DataFrame, pair: str, fold: str) -> DataFrame:
    """Inner rows with ``_k``, the fold they calibrate: the other one of their pair."""
    a, b = (F.substring(pair, i, 1).cast("int") for i in (5, 6))
    k = F.when(F.col(fold) == a, b).when(F.col(fold) == b, a)
    return inner.withColumn("_k", k).where("_k is not null")


def _paired(cal: DataFrame, outer: DataFrame, *, sample: str, fold: str, time: Column) -> DataFrame:
    """Calibration rows with the fold ``_own`` and the time ``_us`` of their sample's outer row, NULL without one.

    ``_second`` marks one row of each sample that comes more than once in a calibration, ``_copy`` numbers the outer rows
    of a sample. Both tables are dealt by sample once, for the numbers and for the join.
    """
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(sample))
    rows = cal.repartition(sample).withColumn("_second", number(sample, "_k") == 2)
    own = outer.select(sample, F.col(fold).alias("_own"), time.alias("_us")).repartition(sample).withColumn("_copy", number(sample))
    return rows.join(own, sample, "left").withColumn("_second", F.col("_second") & (F.coalesce("_copy", F.lit(1)) == 1))


def transfer_counts(paired: DataFrame, outer: DataFrame, *, group: str, fold: str, used: Column, tested: Column) -> DataFrame:
    """One row of counts for each fold: of its calibration (``used`` rows and their groups, and what is wrong) and of its
    outer rows (``tested`` ones and their groups). Groups are told apart by one pass over both tables."""
    one, no, k = F.lit(1), F.lit(0), F.col("_k")
    flag = lambda c: F.when(c, 1).otherwise(0)
    strange = flag(F.col("_own").isNull() | (F.col("_own") == k))
    cal = paired.select(
        k.alias(fold), group, one.alias("met"), strange.alias("strange"), flag(F.col("_second")).alias("twice"), flag(used).alias("used"), no.alias("n"), no.alias("tested")
    )
    own = outer.select(fold, group, *[no.alias(c) for c in ("met", "strange", "twice", "used")], one.alias("n"), flag(tested).alias("tested"))
    names = ("met", "strange", "twice", "used", "n", "tested")
    groups = cal.unionByName(own).groupBy(fold, group).agg(*[F.sum(c).alias(c) for c in names])
    known = F.col(group).isNotNull()
    return groups.groupBy(fold).agg(
        F.count_if(known & (F.col("met") > 0) & (F.col("n") > 0) & F.col(fold).isNotNull()).alias("shared"),
        F.count_if(known & (F.col("used") > 0)).alias("used_groups"), F.count_if(known & (F.col("tested") > 0)).alias("tested_groups"),
        *[F.sum(c).alias(c) for c in names],
    )


def check_transfer(counts: DataFrame) -> None:
    """Raises unless each fold is calibrated by every sample of the other folds once, and by no group of its own."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    there = F.col("n") > 0
    found = counts.agg(
        F.sum("twice").alias("samples twice in a calibration"), F.sum(F.when(there, F.col("strange"))).alias("samples that don't belong"),
        F.count_if(there & (F.col("met") != total - F.col("n"))).alias("folds without all other samples"), F.sum("shared").alias("groups on both sides"),
    ).first()
    refuse(found.asDict())


def transfer(
    inner: DataFrame, outer: DataFrame, arms: Mapping[str, Sequence[str]], *, sample: str, group: str, fold: str, pair: str,
    observed: str, forecast: str, disagreement: str, penalty_rows: float = 100.0,
    time: str | None = None, early_end: str | None = None, later_start: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(outer rows with one column for each arm, one row of facts for each fold).

    The weights of a fold are fitted on the inner predictions of all other folds' samples, made without both folds of
    their pair (:func:`check_transfer`). ``arms`` names the features whose terciles make the cells of an arm;
    ``constant`` is the weight without cells. With ``early_end`` and ``later_start`` only samples before the one
    calibrate and only rows from the other on are given; a fold that is left without either is refused. All folds are
    fitted in one pass.
    """
    outer = materialise(outer)
    features = dict.fromkeys(f for arm in arms.values() for f in arm)
    needed = dict.fromkeys(["_k", sample, group, observed, forecast, disagreement, *features])
    cal = _calibration(inner, pair, fold).select(*needed)
    when = micros(time) if early_end else F.lit(None)
    paired = _paired(cal, outer, sample=sample, fold=fold, time=when.cast("bigint")).drop(sample)
    if early_end:
        used = F.col("_us") < micros(F.lit(early_end).cast("timestamp"))
        tested = micros(time) >= micros(F.lit(later_start).cast("timestamp"))
    else:
        used, tested = F.coalesce("_copy", F.lit(1)) == 1, F.lit(True)
    # Read for the counts and for the weights.
    paired = materialise(paired)
    counts = materialise(transfer_counts(paired, outer, group=group, fold=fold, used=used, tested=tested))
    check_transfer(counts)
    folds = counts.where("n > 0").select(
        F.col(fold).cast(outer.schema[fold].dataType).alias(fold), F.col("used").alias("calibration_rows"), F.col("used_groups").alias("calibration_groups"),
        F.col("tested").alias("test_rows"), F.col("tested_groups").alias("test_groups"),
    )
    refuse({"folds without calibration or test rows": folds.where("calibration_rows = 0 or test_rows = 0").count()})
    fitted = paired.where(used).withColumnRenamed("_k", fold)
    out = outer.where(tested)
    weights = blends.reliability_arms(fitted, [fold], observed, forecast, disagreement, arms, penalty_rows) if arms else {}
    for name, features in arms.items():
        done = blends.apply_reliability(out, weights[name], [fold], forecast, disagreement, features)
        out = done.withColumnsRenamed({"reliability": name, "weight": f"weight_{name}"}).drop("cell")
        out = out.drop("constant").withColumnRenamed("constant_blend", "constant") if name == list(arms)[-1] else out.drop("constant", "constant_blend")
    return out, folds
