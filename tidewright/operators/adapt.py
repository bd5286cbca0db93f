"""Corrections learned from a few local rows or on other folds, and what they do to errors and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.base import finite
from ..functions.stats import seeded_hash
from ..session import materialise
from .conformal import out_of_fold_thresholds
from .fits import ridge_fit, ridge_predict
from .skew import salted_join

FLOOR = 0.05
RIDGE, BOOST = "ridge", "boost"


def few_shot_biases(
    df: DataFrame, *, site: str, row_id: str, window: str, observed: str, log_prediction: str, ks: Sequence[int], n_draws: int, seed: int = 0, floor: float = FLOOR, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., site, draw, k, residual): sum of log residuals of the k rows of the window that a draw picks.

    A draw orders a site's rows by a hash, so the first k are k rows without replacement. Only the first
    max(ks) rows of a site and draw leave a task, however many rows a site has; no draw sorts the others.
    """
    residual = F.ln(F.greatest(finite(observed), F.lit(floor))) - finite(log_prediction)
    rows = df.where(F.col(window)).select(*by, F.col(site), F.col(row_id).alias("_id"), residual.alias("_r")).where("_r is not null")
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("_h", seeded_hash(seed, "draw", "_id"))
    order = Window.partitionBy(*by, site, "draw").orderBy("_h", "_id")
    first = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(ks))
    sums = first.groupBy(*by, site, "draw").agg(F.max("_n").alias("_have"), *[F.sum(F.when(F.col("_n") <= k, F.col("_r"))).alias(f"_k{k}") for k in ks])
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_k{k}").alias("residual")) for k in ks])
    return sums.select(*by, site, "draw", "_have", F.inline(each)).where("k <= _have").drop("_have")


def few_shot_curve(
    df: DataFrame, *, site: str, row_id: str, window: str, evaluate: str, observed: str, log_prediction: str, ks: Sequence[int], shrinkage: Sequence[float],
    n_draws: int = 10, min_eval: int = 1, seed: int = 0, floor: float = FLOOR, by: Sequence[str] = (),
) -> DataFrame:
    """(by..., k, lam, n_sites, n_rows, rmse, rmse_before) of a site's log bias from k rows, shrunk by k / (k + lam).

    The squared error of a site after a bias b is e^2b P - 2 e^b Q + R with three sums over its evaluation rows, so
    no row is repeated per draw. Sites with fewer than k rows to draw from or ``min_eval`` to evaluate are left out.
    """
    y, p = finite(observed), F.exp(finite(log_prediction))
    use = F.col(evaluate) & y.isNotNull() & p.isNotNull()
    sums = df.groupBy(*by, site).agg(
        F.count_if(use).alias("_n"), *[F.coalesce(F.sum(F.when(use, v)), F.lit(0.0)).alias(c) for c, v in (("_pp", p * p), ("_py", p * y), ("_yy", y * y))]
    )
    biases = few_shot_biases(df, site=site, row_id=row_id, window=window, observed=observed, log_prediction=log_prediction, ks=ks, n_draws=n_draws, seed=seed, floor=floor, by=by)
    b = F.col("residual") / (F.col("k") + F.col("lam"))
    each = biases.withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in shrinkage]))).withColumn("_f", F.exp(b))
    factors = each.groupBy(*by, site, "k", "lam").agg(F.avg("_f").alias("_f1"), F.avg(F.col("_f") * F.col("_f")).alias("_f2"))
    both = factors.join(sums.where(F.col("_n") >= max(min_eval, 1)), [*by, site])
    error = F.col("_f2") * F.col("_pp") - 2 * F.col("_f1") * F.col("_py") + F.col("_yy")
    before = F.col("_pp") - 2 * F.col("_py") + F.col("_yy")
    root = lambda total: F.sqrt(F.greatest(F.sum(total), F.lit(0.0)) / F.sum("_n"))
    return both.groupBy(*by, "k", "lam").agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum("_n").alias("n_rows"), root(error).alias("rmse"), root(before).alias("rmse_before")
    )


def best_shrinkage(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., lam, mean_rmse): the shrinkage with the lowest error averaged over k; the smaller of two."""
    means = curve.groupBy(*by, "lam").agg(F.avg("rmse").alias("mean_rmse"))
    return means.groupBy(*by).agg(F.min_by(F.struct("lam", "mean_rmse"), F.struct("mean_rmse", "lam")).alias("_b")).select(*by, "_b.*")


def adapted_coverage(
    df: DataFrame, *, observed: str, centre: str, sigma: str, site: str, fold: str, n_folds: int, biases: DataFrame | None = None, level: float = 0.9, floor: float = FLOOR
) -> DataFrame:
    """(site, n, coverage) of log-normal intervals around adapted centres; the site NULL is all rows.

    ``biases`` (site, bias) shifts the log centres; a site without one stays. Scores are calibrated on the other
    folds with every site weighted equally, after the shift, so the interval's width follows the new centres.
    """
    rows = df.withColumn("_b", F.lit(0.0)) if biases is None else salted_join(df, biases.select(site, F.col("bias").alias("_b")), [site], how="left")
    away = F.abs(F.ln(F.greatest(finite(observed), F.lit(floor))) - finite(centre) - F.coalesce("_b", F.lit(0.0)))
    scored = materialise(rows.select(site, fold, (away / finite(sigma)).alias("_s")).where("_s is not null"))
    limits = out_of_fold_thresholds(scored, "_s", site, fold, n_folds, level)  # one row per fold
    inside = scored.join(F.broadcast(limits), fold).withColumn("_in", (F.col("_s") <= F.col("threshold")).cast("double"))
    return inside.groupingSets([[F.col(site)], []], F.col(site)).agg(F.count(F.lit(1)).alias("n"), F.avg("_in").alias("coverage"))


def check_roles(df: DataFrame, group: str, splits: Sequence[str], target: str) -> None:
    """Refuses splits with a group in two roles or a role without usable rows."""
    crossing = df.groupBy(group).agg(*[F.count_distinct(s).alias(s) for s in splits]).agg(*[F.max(s).alias(s) for s in splits]).first()
    counts = df.where(finite(target).isNotNull()).agg(*[F.count_if(F.col(s) == role).alias(f"{s} {role}") for s in splits for role in ("train", "val", "test")]).first()
    for s in splits:
        if (crossing[s] or 0) > 1:
            raise ValueError(f"a {group} has more than one role in {s}")
        for role in ("train", "val", "test"):
            if not counts[f"{s} {role}"]:
                raise ValueError(f"{s} has no row to {role} with")


def forecast_corrector(
    df: DataFrame, features: Sequence[str], target: str, splits: Sequence[str], *, key: Sequence[str], group: str, ridge_alpha: float = 10.0, boost: Mapping[str, object] | None = None
) -> DataFrame:
    """(split, key..., observed, prediction, arm, val_rmse_ridge, val_rmse_boost) of every split's test rows.

    ``splits`` name columns with the roles train, val and test. Ridge on standardised features and gradient-boosted
    trees are fitted on the train rows, and the arm with the lower error on the val rows (ridge, if equal) predicts
    the test rows. Rows with a missing feature or target take no part. Both fits are distributed aggregates; what
    the driver holds is one model per arm and split.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    usable = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in (*features, target)])
    columns = list(dict.fromkeys([*key, group, *splits]))
    rows = df.where(usable).select(*columns, *[finite(c).alias(f"_x{i}") for i, c in enumerate(features)], finite(target).alias("_y"))
    names = [f"_x{i}" for i in range(len(features))]
    rows = materialise(rows)
    check_roles(rows, group, splits, "_y")
    packed = VectorAssembler(inputCols=names, outputCol="_v").transform(rows)
    settings = {"maxIter": 50, "stepSize": 0.1, "maxDepth": 4, "seed": 0} | dict(boost or {})
    out = None
    for s in splits:
        train = packed.where(F.col(s) == "train")
        linear = ridge_fit(train, names, "_y", alpha=ridge_alpha)
        trees = GBTRegressor(featuresCol="_v", labelCol="_y", predictionCol=BOOST, **settings).fit(train)
        rated = trees.transform(ridge_predict(packed.where(F.col(s) != "train"), linear, names, output=RIDGE))
        rated = materialise(rated.select(*columns, "_y", RIDGE, BOOST))
        error = lambda arm: F.sqrt(F.avg((F.col(arm) - F.col("_y")) ** 2)).alias(arm)
        val = rated.where(F.col(s) == "val").agg(error(RIDGE), error(BOOST)).first()
        arm = RIDGE if val[RIDGE] <= val[BOOST] else BOOST
        part = rated.where(F.col(s) == "test").select(
            F.lit(s).alias("split"), *key, F.col("_y").alias("observed"), F.col(arm).alias("prediction"), F.lit(arm).alias("arm"),
            F.lit(val[RIDGE]).alias("val_rmse_ridge"), F.lit(val[BOOST]).alias("val_rmse_boost"),
        )
        out = part if out is None else out.unionByName(part)
    return out
