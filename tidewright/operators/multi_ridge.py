"""Ridge for wide features and several targets: one matrix of products, one factorisation for all targets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

MODEL = "struct<mu:array<double>,sd:array<double>,coef:array<array<double>>,intercept:array<double>>"
#: Groups whose matrices a task holds at once.
MAX_GROUPS = 256


def _products(batches: Iterator[pa.RecordBatch], shift: list[float]) -> Iterator[pa.RecordBatch]:
    """For each group of a task the products of (1, features, targets), one row of the matrix per output row."""
    sums: dict[str | None, np.ndarray] = {}
    width, offset = len(shift), np.asarray(shift)

    def flush() -> Iterator[pa.RecordBatch]:
        for key, matrix in sums.items():
            rows = pa.ListArray.from_arrays(pa.array(range(0, matrix.size + 1, len(matrix)), pa.int32()), pa.array(matrix.ravel()))
            yield pa.record_batch({"key": pa.array([key] * len(matrix), pa.string()), "i": pa.array(range(len(matrix)), pa.int32()), "values": rows})
        sums.clear()

    for batch in batches:
        keys = batch.column(0).dictionary_encode()
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - offset
        rows = np.hstack([np.ones((len(values), 1)), values])
        codes = keys.indices.to_numpy()
        for code, key in enumerate(keys.dictionary.to_pylist()):
            own = rows[codes == code]
            sums[key] = sums.get(key, 0) + own.T @ own
        if len(sums) > MAX_GROUPS:
            yield from flush()
    yield from flush()


def _solver(shift: list[float], n_features: int, penalty: float, least_scale: float):
    shift = list(shift)

    def run(matrices: pd.Series) -> pd.DataFrame:
        rows = []
        for m in matrices:
            m = np.array([np.asarray(r["values"]) for r in sorted(m, key=lambda r: r["i"])])
            n, d = m[0, 0], n_features
            mean = m[0, 1:] / n
            cov = m[1:, 1:] - n * np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov)[:d], 0) / n)
            sd = np.where(sd < least_scale, 1.0, sd)
            weights = np.linalg.solve(cov[:d, :d] / np.outer(sd, sd) + penalty * np.eye(d), cov[:d, d:] / sd[:, None])
            centre = mean + np.asarray(shift)
            rows.append((centre[:d].tolist(), sd.tolist(), weights.T.tolist(), centre[d:].tolist()))
        return pd.DataFrame(rows, columns=["mu", "sd", "coef", "intercept"])

    return F.pandas_udf(run, MODEL)


def fit(df: DataFrame, features: str, n_features: int, targets: str, n_targets: int, by: str | None = None, penalty: float = 10.0, least_scale: float = 1e-8) -> DataFrame:
    """(by, model) from array columns of features and targets; rows with a missing or non-finite number are left out.

    Each task multiplies its rows as one matrix. What is shuffled is one matrix per task and group; its rows are
    added up as arrays. Values are shifted by their overall means first, so large offsets cost no digits. Features
    are standardised with their population deviation (1, where that is below ``least_scale``).
    """
    both = F.concat(features, targets)
    width = n_features + n_targets
    whole = (F.size(features) == n_features) & (F.size(targets) == n_targets) & F.forall(both, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    key = F.col(by).cast("string") if by else F.lit("")
    rows = df.where(F.coalesce(whole, F.lit(False))).select(key.alias("key"), both.cast("array<double>").alias("values"))
    means = rows.agg(*[F.avg(F.col("values")[k]).alias(f"m{k}") for k in range(width)]).first()  # one number per column
    shift = [m or 0.0 for m in means]
    parts = rows.mapInArrow(partial(_products, shift=shift), "key string, i int, values array<double>")
    added = parts.groupBy("key", "i").agg(F.array(*[F.sum(F.col("values")[k]) for k in range(width + 1)]).alias("values"))
    matrices = added.groupBy("key").agg(F.collect_list(F.struct("i", "values")).alias("m"))  # width + 1 rows each
    models = matrices.select(F.col("key").alias(by or "key"), _solver(shift, n_features, penalty, least_scale)("m").alias("model"))
    return models if by else models.drop("key")


def predicted(features: str | Column, model: str = "model") -> Column:
    """The predictions of a joined model as an array, one per target."""
    m = F.col(model)
    z = F.zip_with(F.zip_with(features, m["mu"], lambda x, mu: x - mu), m["sd"], lambda x, sd: x / sd)
    value = lambda c: F.aggregate(F.zip_with(c, z, lambda w, x: w * x), F.lit(0.0), lambda total, x: total + x)
    return F.zip_with(F.transform(m["coef"], value), m["intercept"], lambda x, b: x + b)


def predict(df: DataFrame, models: DataFrame, features: str, by: str | None = None, output: str = "predictions") -> DataFrame:
    if by:
        keyed = df.withColumn("_key", F.col(by).cast("string"))
        joined = salted_join(keyed, models.select(F.col(by).alias("_key"), "model"), ["_key"], how="left").drop("_key")
    else:
        one = models.withColumn("_1", F.lit(1))  # one row
        joined = df.withColumn("_1", F.lit(1)).join(F.broadcast(one), "_1", "left").drop("_1")
    return joined.withColumn(output, predicted(features)).drop("model")
