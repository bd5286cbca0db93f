"""Equi-joins whose hot keys are split on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, rows_per_task

MAX_HOT_KEYS = 100_000
#: Rows that one task of :func:`dealt` sorts or groups.
DEALT_ROWS = 500_000


def dealt(df: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows, by key in tasks of about ``DEALT_ROWS`` rows; a small table as it is.

    Spark joins shuffled partitions until there are about as many as cores, so a task grows with the table.
    """
    n = -(-rows // DEALT_ROWS)
    return df if n <= 1 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *on)


def _broadcast_rows(df: DataFrame) -> int:
    """Rows of this schema that are certainly small enough to broadcast (some tens of MB)."""
    nested = any(f.dataType.typeName() in ("array", "map", "struct") for f in df.schema)
    return 1_000 if nested else MAX_HOT_KEYS


def _hot_keys(left: DataFrame, right: DataFrame, on: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows on a side, with the number of slices for each side.

    The limit is raised so that at most ``MAX_HOT_KEYS`` keys can exceed it; that bounds the
    table, which is why it may be broadcast.
    """
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    sides = left.select(*on, one.alias("_l"), zero.alias("_r")).unionByName(
        right.select(*on, zero.alias("_l"), one.alias("_r"))
    )
    counts = sides.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    top, total = counts.agg(F.max(F.greatest("_l", "_r")), F.sum(F.col("_l") + F.col("_r"))).first()
    if top is None or top <= limit:
        return None
    limit = max(limit, -(-int(total) // MAX_HOT_KEYS))
    return counts.where((F.col("_l") > limit) | (F.col("_r") > limit)).select(
        *[F.col(k).alias(f"_h{i}") for i, k in enumerate(on)],
        F.ceil(F.col("_l") / limit).cast("int").alias("_nl"),
        F.ceil(F.col("_r") / limit).cast("int").alias("_nr"),
    )


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], *, how: str = "inner", limit: int | None = None, counted: str | None = None
) -> DataFrame:
    """Join on ``on`` (never NULL); a hot key becomes a grid of (left slice, right slice) tasks.

    Both sides may be hot. ``how`` is ``inner``, or ``left``, which attaches a table with one row
    per key: that table is computed once, and broadcast if its row count proves it small, so the
    left side is not even shuffled; otherwise the left side is split where it is hot. ``counted`` names a column
    of that table with the left rows of each key (a bound is enough; keys without a row have few), which saves the
    counting pass.
    """
    asked = limit
    limit = limit or rows_per_task(left.sparkSession)
    if how == "left":
        right = materialise(right)
        if asked is None and right.count() <= _broadcast_rows(right):
            return left.join(F.broadcast(right), list(on), how)
        if counted and (right.agg(F.max(counted)).first()[0] or 0) <= limit:
            return left.join(right, list(on), how)
    hot = _hot_keys(left, right, on, limit)
    if hot is None:
        return left.join(right, list(on), how)
    if how not in ("inner", "left"):
        raise ValueError("a salted join is inner or left")

    def slices(df: DataFrame, own: str, other: str, own_n: str, other_n: str, split: bool) -> DataFrame:
        match = [F.col(k) == F.col(f"_h{i}") for i, k in enumerate(on)]
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        wide = df.join(F.broadcast(hot), cond, "left")
        rows = F.coalesce(F.col(own_n), F.lit(1))
        spread = F.greatest(rows, F.lit(1)) if split else F.lit(1)
        others = F.greatest(F.coalesce(F.col(other_n), F.lit(1)), F.lit(1))
        digest = F.xxhash64(*df.columns)
        wide = wide.withColumn(own, F.pmod(digest, spread).cast("int"))
        if other_n == "_nr" and how == "left":
            return wide.withColumn(other, F.lit(0)).select(*df.columns, own, other)
        return wide.withColumn(other, F.explode(F.sequence(F.lit(0), others - 1))).select(
            *df.columns, own, other
        )

    a = slices(left, "_ls", "_rs", "_nl", "_nr", True)
    b = slices(right, "_rs", "_ls", "_nr", "_nl", how == "inner")
    return a.join(b, [*on, "_ls", "_rs"], how).drop("_ls", "_rs")
