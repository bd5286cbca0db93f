"""Classification scores from a confusion matrix counted in Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import divide
from ..session import materialise

def confusion_matrix(df: DataFrame, true: str, pred: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of every (true, pred) cell of the k by k grid, zeros included, for every group of the input.

    Rows with a class outside 0 to k - 1 are in no cell; ``out_of_range`` counts them.
    """
    cell = F.when(F.col(true).between(0, k - 1) & F.col(pred).between(0, k - 1), F.col(true).cast("int") * k + F.col(pred).cast("int"))
    counts = df.groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each group, its counts by cell: at most k * k entries.
    wide = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "n")))).alias("m"))
    cells = wide.select(*by, "m", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("c"))
    return cells.select(
        *by, F.expr(f"int(c div {k})").alias("true"), F.pmod("c", F.lit(k)).cast("int").alias("pred"), F.coalesce(F.try_element_at("m", "c"), F.lit(0)).alias("n")
    )


def out_of_range(df: DataFrame, true: str, pred: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each group that are in no cell of the matrix."""
    inside = F.col(true).between(0, k - 1) & F.col(pred).between(0, k - 1)
    return df.groupBy(*by).agg(F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_out_of_range"))


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class; undefined values are NULL."""
    tagged = matrix.select(*by, "n", F.explode(F.array(
        F.struct(F.col("true").alias("c"), F.lit(0).alias("as_pred")),
        F.struct(F.col("pred").alias("c"), F.lit(1).alias("as_pred")),
    )).alias("t"), (F.col("true") == F.col("pred")).alias("hit"))
    n, as_true = F.col("n"), F.col("t.as_pred") == 0
    g = tagged.groupBy(*by, F.col("t.c").alias("cls")).agg(
        F.sum(F.when(as_true & F.col("hit"), n).otherwise(0)).alias("_tp"),
        F.sum(F.when(as_true, n).otherwise(0)).alias("support"),
        F.sum(F.when(~as_true, n).otherwise(0)).alias("predicted"),
    )
    tp = F.col("_tp").cast("double")
    p, r = divide(tp, F.col("predicted")), divide(tp, F.col("support"))
    return g.select(
        *by, "cls", p.alias("precision"), r.alias("recall"), divide(2 * p * r, p + r).alias("f1"), "support", "predicted"
    )


def report_from_matrix(matrix: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced, macro and weighted scores, and the ordinal metrics, per group.

    The matrix has k*k rows per group; it is materialised once and everything after is small.
    """
    matrix = materialise(matrix)
    n, i, j = F.col("n"), F.col("true"), F.col("pred")
    d = (i - j).cast("double")
    cell = matrix.groupBy(*by).agg(
        F.sum(n).alias("n"),
        divide(F.sum(F.when(i == j, n).otherwise(0)).cast("double"), F.sum(n)).alias("accuracy"),
        divide(F.sum(n * F.abs(d)), F.sum(n)).alias("ordinal_mae"),
        divide(F.sum(F.when(F.abs(d) <= 1, n).otherwise(0)).cast("double"), F.sum(n)).alias("within_one_accuracy"),
        F.sum(n * d * d).alias("_seen"),
    )
    pc = per_class(matrix, by)
    present = (F.col("support") + F.col("predicted")) > 0

    def macro(c: str) -> Column:
        return F.avg(F.when(present, F.coalesce(F.col(c), F.lit(0.0)))).alias(f"{c}_macro")

    def weighted(c: str) -> Column:
        total = F.sum("support")
        return divide(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("support")), total).alias(f"{c}_weighted")

    # Expected squared distance under independence, from the first two moments of the margins.
    c, s, q = F.col("cls").cast("double"), F.col("support"), F.col("predicted")
    classes = pc.groupBy(*by).agg(
        F.avg("recall").alias("balanced_accuracy"),
        *[macro(x) for x in ("precision", "recall", "f1")],
        *[weighted(x) for x in ("precision", "recall", "f1")],
        F.sum(s * c).alias("_s1"), F.sum(s * c * c).alias("_s2"),
        F.sum(q * c).alias("_q1"), F.sum(q * c * c).alias("_q2"),
    )
    keys = list(by) or ["_1"]
    if not by:
        cell, classes = cell.withColumn("_1", F.lit(1)), classes.withColumn("_1", F.lit(1))
    out = cell.join(classes, keys)
    expected = F.col("_s2") + F.col("_q2") - 2 * F.col("_s1") * F.col("_q1") / F.col("n")
    kappa = F.when(expected > 1e-12, 1 - F.col("_seen") / expected)
    return out.withColumn("quadratic_weighted_kappa", kappa).drop("_1", "_seen", "_s1", "_s2", "_q1", "_q2")


def classification_report(df: DataFrame, true: str, pred: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    return report_from_matrix(confusion_matrix(df, true, pred, k, by), k, by)


def majority_class(df: DataFrame, cls: str, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent class per key, ties to the lower class."""
    counts = df.where(F.col(cls) >= 0).groupBy(*by, cls).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(cls, F.struct(-F.col("_n"), F.col(cls))).alias("majority"))


def class_table(df: DataFrame, cls: str, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Counts of each class per group, and the row total."""
    cols = [F.count_if(F.col(cls) == i).alias(n) for i, n in enumerate(names)]
    return df.groupBy(*by).agg(*cols).withColumn("total", sum((F.col(n) for n in names), F.lit(0)))


def inverse_frequency_weights(df: DataFrame, cls: str, output: str = "weight") -> DataFrame:
    """Inverse class frequency scaled to mean one: n / (classes present * class count)."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    total, k = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    weights = counts.select(cls, (F.lit(float(total or 0)) / (F.lit(k) * F.col("_n"))).alias(output))
    from .skew import salted_join

    return salted_join(df, weights, [cls], how="left")


def assessable(df: DataFrame, cls: str, day: str, min_rows: int, min_days: int) -> DataFrame:
    """Classes with enough rows on enough days."""
    return df.groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("days")
    ).withColumn("assessable", (F.col("n") >= min_rows) & (F.col("days") >= min_days))
