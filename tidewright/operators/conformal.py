"""Conformal thresholds when whole groups are exchangeable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import finite
from ..session import materialise
from .ordered import RunningSum, ordered
from .skew import salted_join


def threshold(
    df: DataFrame, score: str, group: str, level: float = 0.9, by: Sequence[str] = (), *, limit=None
) -> DataFrame:
    """The ``level`` quantile of the scores with every group weighted equally.

    A score of a group with n of K groups weighs 1 / ((K + 1) n); the mass left is at infinity,
    which is the answer when there are too few groups. Equal scores are summed before the scan.
    """
    ok = df.select(*by, group, finite(score).alias("_s")).where("_s is not null")
    keys = list(by) or ["_all"]
    if not by:
        ok = ok.withColumn("_all", F.lit(0))
    counts = ok.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    per_score = ok.groupBy(*keys, group, "_s").agg(F.count(F.lit(1)).alias("_m"))
    joined = salted_join(per_score, counts, [*keys, group], how="left", limit=limit)
    # Read by the count of the scan and by the scan itself.
    mass = materialise(joined.groupBy(*keys, "_s").agg(F.sum(F.col("_m") / F.col("_n")).alias("_w")))
    run = ordered(mass, keys, ["_s"], limit=limit, _cum=RunningSum(F.col("_w")))
    run = salted_join(run, groups, keys, how="left", limit=limit)
    hit = F.col("_cum") / (F.col("_k") + 1) >= level - 1e-12
    out = run.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(hit, F.col("_s"))), F.lit(float("inf"))).alias("threshold"),
        F.max("_k").alias("n_groups"),
    )
    return out.drop("_all")


def out_of_fold_thresholds(
    df: DataFrame, score: str, group: str, fold: str, n_folds: int, level: float = 0.9, *, limit=None
) -> DataFrame:
    """(fold, threshold) with each fold calibrated on the rows of the other folds.

    Every fold has its own running mass in one scan over the scores, and a fold's complement is
    the sum of the others, so no row is copied per fold. A group must lie in one fold.
    """
    folds = range(n_folds)
    ok = df.select(group, fold, finite(score).alias("_s")).where("_s is not null")
    counts = materialise(ok.groupBy(group, fold).agg(F.count(F.lit(1)).alias("_n")))
    if counts.groupBy(group).count().where("count > 1").limit(1).count():
        raise ValueError(f"a {group} lies in more than one {fold}")
    per_score = ok.groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_m"))
    joined = salted_join(per_score, counts, [group], how="left", limit=limit)
    mass = F.col("_m") / F.col("_n")
    wide = joined.groupBy("_s").agg(
        *[F.sum(F.when(F.col(fold) == k, mass).otherwise(0.0)).alias(f"_w{k}") for k in folds]
    )
    wide = materialise(wide)
    run = ordered(wide, [], ["_s"], limit=limit, **{f"_c{k}": RunningSum(F.col(f"_w{k}")) for k in folds})
    sizes = {r[0]: r[1] for r in counts.groupBy(fold).agg(F.count(F.lit(1))).collect()}  # n_folds rows
    total = sum(sizes.values())
    whole = sum((F.col(f"_c{k}") for k in folds), F.lit(0.0))
    items = []
    for k in folds:
        others = total - sizes.get(k, 0)
        hit = (whole - F.col(f"_c{k}")) / (others + 1) >= level - 1e-12
        t = F.coalesce(F.min(F.when(hit, F.col("_s"))), F.lit(float("inf")))
        items.append(F.struct(F.lit(k).alias(fold), t.alias("threshold")))
    return run.agg(F.array(*items).alias("t")).select(F.inline("t"))


def coverage(df: DataFrame, score: str, thresholds: DataFrame, fold: str, by: Sequence[str]) -> DataFrame:
    """Share of scores within the threshold of their fold; the thresholds are one row per fold."""
    joined = df.join(F.broadcast(thresholds), fold)
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(score) <= F.col("threshold")).cast("double")).alias("coverage")
    )
