"""Resampling intervals from sufficient statistics.

Rows are reduced to one small vector of sums per group, so the cost of a replicate depends on
the number of groups, not rows. Draws are md5 numbers of (seed, replicate, draw), so they can be
repeated anywhere; every replicate is an exact draw of K groups with replacement.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import divide
from ..functions.stats import seeded_hash
from ..session import materialise
from .metrics import complete_pairs
from .ordered import ordered, position


def regression_sums(y: str = "_y", p: str = "_p") -> dict[str, Column]:
    """Sums from which bias, MAE, RMSE and R2 follow."""
    a, b = F.col(y), F.col(p)
    e = b - a
    return {
        "n": F.count(e).cast("double"), "se": F.sum(e), "sa": F.sum(F.abs(e)), "see": F.sum(e * e),
        "sy": F.sum(a), "syy": F.sum(a * a),
    }


METRICS = {
    "bias": lambda: F.col("se") / F.col("n"),
    "mae": lambda: F.col("sa") / F.col("n"),
    "rmse": lambda: F.sqrt(F.col("see") / F.col("n")),
    "r2": lambda: 1 - divide(F.col("see"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")),
}


def indexed(groups: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Groups numbered from 0 in key order, and their number."""
    out = ordered(groups, [], [key], _pos=position()).withColumn("_i", F.col("_pos") - 1).drop("_pos")
    return out, groups.count()


def draws(spark, k: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, group index, times drawn): K draws with replacement in each replicate."""
    n = k * replicates
    parts = max(1, min(10_000, n // 500_000 + 1))
    base = spark.range(0, n, 1, parts)
    rep, draw = F.floor(F.col("id") / k).alias("replicate"), F.pmod("id", F.lit(k)).alias("draw")
    d = base.select(rep, draw).withColumn("_i", F.pmod(seeded_hash(seed, "replicate", "draw"), F.lit(k)))
    return d.groupBy("replicate", "_i").agg(F.count(F.lit(1)).alias("times"))


def resample(
    stats: DataFrame, key: str, sums: Sequence[str], *, replicates: int, seed: int = 0
) -> DataFrame:
    """Sums of each replicate: one row per replicate. ``stats`` has one row per group and is
    best materialised, as it is counted, numbered and joined."""
    numbered, k = indexed(stats, key)
    picked = draws(stats.sparkSession, k, replicates, seed).join(numbered, "_i")
    return picked.groupBy("replicate").agg(*[F.sum(F.col(s) * F.col("times")).alias(s) for s in sums])


def percentile_interval(reps: DataFrame, values: Mapping[str, Column], alpha: float = 0.05) -> DataFrame:
    """``<name>_lo`` and ``<name>_hi`` over the replicates (a bounded number of rows)."""
    aggs = []
    for name, v in values.items():
        aggs.append(F.percentile(v, alpha / 2).alias(f"{name}_lo"))
        aggs.append(F.percentile(v, 1 - alpha / 2).alias(f"{name}_hi"))
    return reps.agg(*aggs)


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    one = F.lit(1)
    return a.withColumn("_1", one).join(b.withColumn("_1", one), "_1").drop("_1")


def cluster_bootstrap(
    df: DataFrame, true: str, pred: str, group: str, names: Sequence[str] = ("rmse",), *,
    replicates: int = 2000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """Point estimate and percentile interval of each metric, resampling whole groups."""
    sums = regression_sums()
    stats = complete_pairs(df, true, pred).groupBy(group).agg(*[v.alias(k) for k, v in sums.items()])
    stats = materialise(stats)
    point = stats.agg(*[F.sum(k).alias(k) for k in sums]).select(*[METRICS[m]().alias(m) for m in names])
    reps = resample(stats, group, list(sums), replicates=replicates, seed=seed)
    return _beside(point, percentile_interval(reps, {m: METRICS[m]() for m in names}, alpha))


def paired_bootstrap(
    df: DataFrame, true: str, pred_a: str, pred_b: str, group: str, metric: str = "rmse", *,
    replicates: int = 2000, alpha: float = 0.05, seed: int = 0, equal_groups: bool = False,
) -> DataFrame:
    """``metric(a) - metric(b)`` with an interval from the same draws for both arms.

    ``equal_groups`` averages the groups' mean squared errors instead of pooling rows.
    """
    rows = complete_pairs(df, true, pred_a).withColumn("_q", F.col(pred_b).cast("double"))
    rows = rows.where("_q is not null and not isnan(_q)")
    a, b = regression_sums("_y", "_p"), regression_sums("_y", "_q")
    stats = materialise(
        rows.groupBy(group).agg(
            *[v.alias(f"a_{k}") for k, v in a.items()], *[v.alias(f"b_{k}") for k, v in b.items()]
        )
    )
    if equal_groups:
        stats = stats.select(group, *[
            (F.col(f"{s}_{k}") / F.col(f"{s}_n")).alias(f"{s}_{k}") for s in "ab" for k in a if k != "n"
        ], F.lit(1.0).alias("a_n"), F.lit(1.0).alias("b_n"))
    names = [f"{s}_{k}" for s in "ab" for k in a]

    def gap(frame: DataFrame) -> DataFrame:
        for side in "ab":
            cols = frame.columns
            arm = frame.withColumns({k: F.col(f"{side}_{k}") for k in a})
            frame = arm.withColumn(f"m_{side}", METRICS[metric]()).select(*cols, f"m_{side}")
        return frame.withColumn("delta", F.col("m_a") - F.col("m_b"))

    point = gap(stats.agg(*[F.sum(k).alias(k) for k in names])).select(
        F.col("m_a").alias(f"{metric}_a"), F.col("m_b").alias(f"{metric}_b"), "delta"
    )
    reps = gap(resample(stats, group, names, replicates=replicates, seed=seed))
    return _beside(point, percentile_interval(reps, {"delta": F.col("delta")}, alpha))


def moving_block_bootstrap(
    df: DataFrame, true: str, pred: str, order: Sequence[str], names: Sequence[str] = ("rmse",), *,
    block: int = 24, replicates: int = 200, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """Contiguous blocks in ``order`` are resampled; the last block is cut to the series length.

    Running sums turn a block into the difference of two rows, so a replicate needs
    ``n / block`` lookups instead of ``n`` rows.
    """
    from .ordered import RunningSum

    pairs = complete_pairs(df, true, pred).select(*order, "_y", "_p")
    e = F.col("_p") - F.col("_y")
    parts = {"se": e, "sa": F.abs(e), "see": e * e, "sy": F.col("_y"), "syy": F.col("_y") * F.col("_y")}
    run = ordered(
        pairs, [], list(order), _pos=position(), **{f"c_{k}": RunningSum(v) for k, v in parts.items()}
    ).select("_pos", *[f"c_{k}" for k in parts])
    zero = run.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("_pos"), *[F.lit(0.0).alias(f"c_{k}") for k in parts]
    )
    run = run.unionByName(zero)
    n = pairs.count()
    length = max(1, min(block, n))
    blocks = -(-n // length)
    base = run.sparkSession.range(0, blocks * replicates)
    rep, b = F.floor(F.col("id") / blocks).alias("replicate"), F.pmod("id", F.lit(blocks)).alias("b")
    starts = base.select(rep, b).withColumn("s", F.pmod(seeded_hash(seed, "replicate", "b"), F.lit(n - length + 1)))
    size = F.when(F.col("b") == blocks - 1, n - (blocks - 1) * length).otherwise(length)
    edges = starts.select("replicate", F.explode(F.array(
        F.struct(F.col("s").alias("_pos"), F.lit(-1).alias("sign")),
        F.struct((F.col("s") + size).alias("_pos"), F.lit(1).alias("sign")),
    )).alias("x")).select("replicate", "x._pos", "x.sign")
    sums = edges.join(run, "_pos").groupBy("replicate").agg(
        *[F.sum(F.col("sign") * F.col(f"c_{k}")).alias(k) for k in parts]
    ).withColumn("n", F.lit(float(n)))
    point = pairs.agg(*[F.sum(v).alias(k) for k, v in parts.items()]).withColumn("n", F.lit(float(n)))
    point = point.select(*[METRICS[m]().alias(m) for m in names])
    return _beside(point, percentile_interval(sums, {m: METRICS[m]() for m in names}, alpha))


def custom_bootstrap(
    df: DataFrame, group: str, sums: Mapping[str, Column], statistic: Column, *,
    replicates: int = 2000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """Interval of any statistic that is an expression over named per-group sums."""
    stats = materialise(df.groupBy(group).agg(*[v.alias(k) for k, v in sums.items()]))
    point = stats.agg(*[F.sum(k).alias(k) for k in sums]).select(statistic.alias("value"))
    reps = resample(stats, group, list(sums), replicates=replicates, seed=seed)
    return _beside(point, percentile_interval(reps, {"value": statistic}, alpha))
