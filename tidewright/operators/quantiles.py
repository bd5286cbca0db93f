"""Exact quantiles and ranks that do not gather a hot group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise, rows_per_task
from .ordered import RunningSum, group_sizes, largest_group, ordered
from .skew import dealt, salted_join

WHOLE = "_whole"


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(WHOLE, F.lit(0)), [WHOLE])


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], *, limit: int | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per entry of ``probs``.

    Small groups use the built-in exact aggregate. A hot group is reduced to value counts,
    scanned in order, and only the rows that cover a wanted rank are kept.
    """
    asked = limit
    limit = limit or rows_per_task(df.sparkSession)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, value)
    rows, keys = _keyed(rows, by)
    # The built-in aggregate holds a group's distinct values in memory.
    if largest_group(rows, keys) <= max(limit // 10, 1):
        out = rows.groupBy(*keys).agg(*[F.percentile(value, p).alias(k) for k, p in probs.items()])
        return out.drop(WHOLE)
    counts = materialise(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    totals = materialise(counts.groupBy(*keys).agg(F.sum("_c").alias("_total"), F.count(F.lit(1)).alias("_different")))
    most = totals.agg(F.max("_different")).first()[0]
    seen = ordered(counts, keys, [value], limit=limit, largest=most, _cum=RunningSum(F.col("_c")))
    seen = salted_join(seen, totals, keys, how="left", limit=asked, counted="_different")
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1

    def at(rank):
        return F.max(F.when((rank >= first) & (rank <= last), F.col(value).cast("double")))

    out, wanted = [], F.lit(False)
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        wanted = wanted | ((lo >= first) & (lo <= last)) | ((hi >= first) & (hi <= last))
        weight = F.max(h - lo)
        out.append((at(lo) + weight * (at(hi) - at(lo))).alias(name))
    return seen.where(wanted).groupBy(*keys).agg(*out).drop(WHOLE)


def quantiles_of(df: DataFrame, by: Sequence[str], wanted: dict[str, dict[str, float]], *, limit: int | None = None) -> DataFrame:
    """Quantiles per group of several columns (column to name to probability), in one aggregate while groups are small."""
    limit = limit or rows_per_task(df.sparkSession)
    clean = {v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v)) for v in wanted}
    rows, keys = _keyed(df.select(*by, *[c.alias(v) for v, c in clean.items()]), by)
    if largest_group(rows, keys) <= max(limit // 10, 1):
        return rows.groupBy(*keys).agg(*[F.percentile(v, p).alias(k) for v, probs in wanted.items() for k, p in probs.items()])
    out = None
    for value, probs in wanted.items():
        one = quantiles(df, by, value, probs, limit=limit)
        out = one if out is None else out.join(one, list(by), "full")
    return out


def median(df: DataFrame, by: Sequence[str], value: str, name: str, **kw) -> DataFrame:
    return quantiles(df, by, value, {name: 0.5}, **kw)


def average_ranks(
    df: DataFrame, by: Sequence[str], wanted: Mapping[str, str], *, limit: int | None = None
) -> DataFrame:
    """Ranks from 1 of some columns (column to new name) with ties sharing their average rank.

    Small groups are dealt over the tasks once and sorted once for each column. The ranks of a hot group come from its
    values' counts and are joined to its rows.
    """
    asked = limit
    limit = limit or rows_per_task(df.sparkSession)
    rows, keys = _keyed(df, by)
    largest, total = group_sizes(rows, keys)
    if largest <= limit:
        rows = dealt(rows, keys, total)
        for value, output in wanted.items():
            w = Window.partitionBy(*keys).orderBy(value)
            ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
            rows = rows.withColumn(output, F.rank().over(w) + (ties - 1) / 2)
        return rows.drop(WHOLE)
    for value, output in wanted.items():
        counts = materialise(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
        seen = ordered(counts, keys, [value], limit=limit, _cum=RunningSum(F.col("_c")))
        ranks = seen.select(*keys, value, (F.col("_cum") - (F.col("_c") - 1) / 2).alias(output), "_c")
        on = [*keys, value]
        rows = salted_join(dealt(rows, on, total), ranks, on, how="left", limit=asked, counted="_c").drop("_c")
    return rows.drop(WHOLE)


def average_rank(
    df: DataFrame, by: Sequence[str], value: str, output: str, *, limit: int | None = None
) -> DataFrame:
    """Rank from 1 with ties sharing their average rank."""
    return average_ranks(df, by, {value: output}, limit=limit)


def spearman(
    df: DataFrame, by: Sequence[str], x: str, y: str, *, output: str = "spearman", limit: int | None = None, min_pairs: int = 3
) -> DataFrame:
    """Rank correlation of complete pairs; NULL below ``min_pairs`` or for a constant side."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*by, x, y]))
    pairs = average_ranks(pairs, by, {x: "_rx", y: "_ry"} if x != y else {x: "_rx"}, limit=limit)
    pairs = pairs if x != y else pairs.withColumn("_ry", F.col("_rx"))
    usable = (F.count(F.lit(1)) >= min_pairs) & (F.max("_rx") > F.min("_rx")) & (F.max("_ry") > F.min("_ry"))
    rho = F.when(usable, F.corr("_rx", "_ry")).alias(output)
    return pairs.groupBy(*by).agg(rho) if by else pairs.agg(rho)
