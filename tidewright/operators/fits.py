"""Baselines and linear combiners: a fit is an aggregate, a prediction a join.

Only sums leave the rows. The small linear systems are solved inside tasks, one per group row,
by an Arrow-batched function, so many groups are solved in parallel and nothing is collected.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import divide, finite
from .skew import salted_join

MODEL = "struct<mu:array<double>,sd:array<double>,coef:array<double>,intercept:double>"


def gram_sums(features: Sequence[str], target: str) -> dict[str, Column]:
    """Sums of products of complete rows, as one array column and a few scalars."""
    x = [finite(f) for f in features]
    y = finite(target)
    ok = y.isNotNull()
    for c in x:
        ok = ok & c.isNotNull()
    x = [F.when(ok, c) for c in x]
    y = F.when(ok, y)
    zero = F.lit(0.0)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    d = len(x)
    return {
        "n": F.count(y).cast("double"),
        "sx": F.array(*[total(c) for c in x]),
        "sxx": F.array(*[total(x[i] * x[j]) for i in range(d) for j in range(i, d)]),
        "sxy": F.array(*[total(c * y) for c in x]),
        "sy": total(y),
        "syy": total(y * y),
    }


def _solver():
    """Ridge on standardised features from sums, one system per row.

    The function is built when a plan is, and holds all it needs, so tasks only need NumPy.
    """

    def square(upper, d):
        out = np.zeros((d, d))
        out[np.triu_indices(d)] = upper
        return out + np.triu(out, 1).T

    def run(n: pd.Series, sx: pd.Series, sxx: pd.Series, sxy: pd.Series, sy: pd.Series, alpha: pd.Series) -> pd.DataFrame:
        rows = []
        for k, a, u, b, t, penalty in zip(n, sx, sxx, sxy, sy, alpha, strict=True):
            d = len(a)
            if k < 1:
                rows.append((None, None, None, None))
                continue
            mu = np.asarray(a) / k
            cov = square(np.asarray(u), d) - k * np.outer(mu, mu)
            sd = np.sqrt(np.maximum(np.diag(cov) / k, 0))
            sd = np.where(sd > 1e-12 * np.maximum(np.abs(mu), 1), sd, 1.0)
            z = cov / np.outer(sd, sd) + penalty * np.eye(d)
            rhs = (np.asarray(b) - mu * t) / sd
            coef = np.linalg.lstsq(z, rhs, rcond=None)[0] if penalty == 0 else np.linalg.solve(z, rhs)
            rows.append((mu.tolist(), sd.tolist(), coef.tolist(), t / k))
        return pd.DataFrame(rows, columns=["mu", "sd", "coef", "intercept"])

    return F.pandas_udf(run, MODEL)


def solve(sums: DataFrame, alpha: float | Column = 1.0) -> DataFrame:
    """Adds ``model`` to a table of Gram sums."""
    penalty = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return sums.withColumn("model", _solver()("n", "sx", "sxx", "sxy", "sy", penalty.cast("double")))


def ridge_fit(
    df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), alpha: float = 1.0
) -> DataFrame:
    """(by..., model); complete rows only, features standardised with population deviation."""
    sums = df.groupBy(*by).agg(*[v.alias(k) for k, v in gram_sums(features, target).items()])
    return solve(sums, alpha).select(*by, "model")


def linear_value(features: Sequence[str], model: str = "model") -> Column:
    """Prediction of a joined model; NULL for a missing feature."""
    m = F.col(model)
    terms = [(finite(f) - m["mu"][i]) / m["sd"][i] * m["coef"][i] for i, f in enumerate(features)]
    return m["intercept"] + sum(terms[1:], terms[0])


def ridge_predict(
    df: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str] = (), output: str = "prediction"
) -> DataFrame:
    if by:
        joined = salted_join(df, models, by, how="left")
    else:
        one = F.lit(1)
        # One row.
        joined = df.withColumn("_1", one).join(F.broadcast(models.withColumn("_1", one)), "_1").drop("_1")
    return joined.withColumn(output, linear_value(features)).drop("model")


def _plus(a: str, b: str, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def out_of_fold_sums(df: DataFrame, features: Sequence[str], target: str, fold: str) -> DataFrame:
    """Gram sums of the complement of each fold: the total minus the fold (one row per fold)."""
    names = ("n", "sx", "sxx", "sxy", "sy", "syy")
    own = df.groupBy(fold).agg(*[v.alias(k) for k, v in gram_sums(features, target).items()])
    total = df.agg(*[v.alias(f"t_{k}") for k, v in gram_sums(features, target).items()])
    both = own.withColumn("_1", F.lit(1)).join(F.broadcast(total.withColumn("_1", F.lit(1))), "_1")
    cols = [
        (_plus(f"t_{k}", k, -1) if k in ("sx", "sxx", "sxy") else F.col(f"t_{k}") - F.col(k)).alias(k)
        for k in names
    ]
    return both.select(fold, *cols)


def ridge_out_of_fold(
    df: DataFrame, features: Sequence[str], target: str, fold: str, alpha: float = 1.0, output="prediction"
) -> DataFrame:
    """Each row predicted by the model of the other folds; a missing feature counts as its mean."""
    models = solve(out_of_fold_sums(df, features, target, fold), alpha).select(fold, "model")
    joined = salted_join(df, models, [fold], how="left")
    m = F.col("model")
    terms = [
        F.coalesce((finite(f) - m["mu"][i]) / m["sd"][i], F.lit(0.0)) * m["coef"][i]
        for i, f in enumerate(features)
    ]
    return joined.withColumn(output, m["intercept"] + sum(terms[1:], terms[0])).drop("model")


def _squared_error():
    """Sum of squared errors of a model on rows known only by their sums."""

    def square(upper, d):
        out = np.zeros((d, d))
        out[np.triu_indices(d)] = upper
        return out + np.triu(out, 1).T

    def run(
        model: pd.DataFrame, n: pd.Series, sx: pd.Series, sxx: pd.Series, sxy: pd.Series, sy: pd.Series, syy: pd.Series
    ) -> pd.Series:
        out = []
        for mu, sd, coef, b0, k, a, u, b, t, q in zip(
            model["mu"], model["sd"], model["coef"], model["intercept"], n, sx, sxx, sxy, sy, syy, strict=True
        ):
            if mu is None or k == 0:
                out.append(None)
                continue
            w = np.asarray(coef) / np.asarray(sd)
            c = b0 - w @ np.asarray(mu)
            g = square(np.asarray(u), len(a))
            sse = q - 2 * (w @ np.asarray(b) + c * t) + w @ g @ w + 2 * c * (w @ np.asarray(a)) + k * c * c
            out.append(max(float(sse), 0.0))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


def ridge_select_alpha(
    df: DataFrame, features: Sequence[str], target: str, *, role: str, alphas: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., alpha, val_rmse, model) with the penalty of lowest validation error per group.

    Validation errors come from the sums of the validation rows, so rows are read once.
    """
    sums = gram_sums(features, target)
    parts = df.where(F.col(role).isin("train", "val")).groupBy(*by, role)
    parts = parts.agg(*[v.alias(k) for k, v in sums.items()])
    train = parts.where(F.col(role) == "train").drop(role)
    val = parts.where(F.col(role) == "val").select(*by, *[F.col(k).alias(f"v_{k}") for k in sums])
    fitted = train.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    fitted = solve(fitted, F.col("alpha")).select(*by, "alpha", "model")
    keys = list(by)
    if not by:
        fitted, val, keys = fitted.withColumn("_1", F.lit(1)), val.withColumn("_1", F.lit(1)), ["_1"]
    both = fitted.join(val, keys)
    sse = _squared_error()("model", *[f"v_{k}" for k in ("n", "sx", "sxx", "sxy", "sy", "syy")])
    both = both.withColumn("val_rmse", F.sqrt(sse / F.col("v_n")))
    best = F.min_by(F.struct("alpha", "val_rmse", "model"), F.struct("val_rmse", "alpha"))
    return both.groupBy(*keys).agg(best.alias("b")).select(*by, "b.alpha", "b.val_rmse", "b.model")


def linear_correction(df: DataFrame, x: str, y: str, rows: Column, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line ``y = a + b x`` on the chosen complete rows; NULL below two."""
    u, v = F.when(rows, finite(x)), F.when(rows, finite(y))
    ok = u.isNotNull() & v.isNotNull()
    n = F.count_if(ok)
    return df.groupBy(*by).agg(
        F.when(n >= 2, F.regr_intercept(v, u)).alias("a"), F.when(n >= 2, F.regr_slope(v, u)).alias("b")
    )


def power_law(df: DataFrame, x: str, y: str, rows: Column, by: Sequence[str] = ()) -> DataFrame:
    """y = exp(a) x^b on positive rows."""
    ok = rows & (F.col(x) > 0) & (F.col(y) > 0)
    u, v = F.when(ok, F.ln(x)), F.when(ok, F.ln(y))
    return df.groupBy(*by).agg(F.regr_intercept(v, u).alias("a"), F.regr_slope(v, u).alias("b"))


def climatology(train: DataFrame, keys: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Mean per key, and the global mean as one row."""
    value = F.avg(finite(target))
    return train.groupBy(*keys).agg(value.alias("_mean")), train.agg(value.alias("_global"))


def climatology_predict(df: DataFrame, train: DataFrame, keys: Sequence[str], target: str, output="climatology") -> DataFrame:
    table, whole = climatology(train, keys, target)
    one = F.lit(1)
    out = salted_join(df, table, keys, how="left").withColumn("_1", one)
    out = out.join(F.broadcast(whole.withColumn("_1", one)), "_1")  # one row
    return out.withColumn(output, F.coalesce("_mean", "_global")).drop("_1", "_mean", "_global")


def geometric_ratio_out_of_fold(df: DataFrame, x: str, y: str, fold: str) -> DataFrame:
    """(fold, ratio): geometric mean of y/x over the rows of the other folds."""
    ok = (F.col(x) > 0) & (F.col(y) > 0)
    r = F.when(ok, F.ln(F.col(y) / F.col(x)))
    own = df.groupBy(fold).agg(F.coalesce(F.sum(r), F.lit(0.0)).alias("s"), F.count(r).alias("n"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn")).withColumn("_1", F.lit(1))
    both = own.withColumn("_1", F.lit(1)).join(F.broadcast(total), "_1")  # one row
    return both.select(fold, F.exp(divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))).alias("ratio"))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(df)


def _complete(features: Sequence[str]) -> Column:
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return known


def fit_logistic(df: DataFrame, features: Sequence[str], cls: str, weight: str | None = None, l2: float = 1e-3):
    """Weighted multinomial logistic model on standardised features (``pyspark.ml``), of rows with all features.

    The solver minimises mean loss + regParam/2 |coef|^2, so regParam is twice ``l2``.
    """
    from pyspark.ml.classification import LogisticRegression

    lr = LogisticRegression(
        featuresCol="_x", labelCol=cls, family="multinomial", regParam=2 * l2, standardization=True, maxIter=200
    )
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(_assembled(df.where(_complete(features)), features))


def predict_logistic(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every row with ``prediction`` and the ``probability`` of each class; NULL where a feature is missing."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_assembled(df, features))
    known = _complete(features)
    return out.select(
        *df.columns, F.when(known, F.col("prediction")).cast("int").alias("prediction"), F.when(known, vector_to_array("probability")).alias("probability")
    )


def site_alignment(df: DataFrame, vector: str, site: str, output: str = "aligned") -> DataFrame:
    """Each site's vectors scaled per dimension to mean zero and deviation one.

    Moments are aggregated per (site, dimension) with map-side combine; the per-site arrays have
    the length of one vector.
    """
    long = df.select(site, F.posexplode_outer(vector).alias("_d", "_v"))
    v = F.col("_v").cast("double")
    m = long.groupBy(site, "_d").agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    packed = m.groupBy(site).agg(F.array_sort(F.collect_list(F.struct("_d", "m", "s"))).alias("_moments"))
    joined = salted_join(df, packed, [site], how="left")
    scaled = F.zip_with(
        vector, "_moments",
        lambda x, k: (x.cast("double") - k["m"]) / F.when(k["s"] > 0, k["s"]).otherwise(1.0),
    )
    return joined.withColumn(output, scaled).drop("_moments")
