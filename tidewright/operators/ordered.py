"""Ordered scans (previous row, running sums, last known value) that survive hot keys.

A plain window sorts a whole key in one task. That is the best plan while every key is small,
and it is what runs then. When one key holds more rows than a task should sort, the rows are
range-partitioned by key and order into chunks of near-equal size, materialised once, scanned
chunk by chunk, and joined to the carry of the chunks before (or after). Only keys that
straddle a chunk border have a carry: at most two rows per chunk, which bounds the broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise, rows_per_task, shuffle_partitions

CHUNK = "_chunk"


@dataclass(frozen=True)
class Prev:
    """Value of the row before (NULL on the first)."""

    value: Column


@dataclass(frozen=True)
class Next:
    """Value of the row after (NULL on the last)."""

    value: Column


@dataclass(frozen=True)
class RunningSum:
    """Sum up to and including the row."""

    value: Column


@dataclass(frozen=True)
class RunningMin:
    """Smallest value up to and including the row."""

    value: Column


@dataclass(frozen=True)
class RunningMax:
    """Largest value up to and including the row."""

    value: Column


@dataclass(frozen=True)
class LastKnown:
    """Latest non-NULL value at or before the row."""

    value: Column


@dataclass(frozen=True)
class NextKnown:
    """First non-NULL value at or after the row."""

    value: Column


Spec = Prev | Next | RunningSum | RunningMin | RunningMax | LastKnown | NextKnown
#: What a running value is made with, and how two parts of it become one.
RUNNING = {RunningSum: (F.sum, lambda a, b: a + b), RunningMin: (F.min, F.least), RunningMax: (F.max, F.greatest)}


def position() -> RunningSum:
    """Row number from 1."""
    return RunningSum(F.lit(1).cast("bigint"))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key: one pruned, map-side combined count."""
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and of the table, counted like :func:`largest_group`."""
    top, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return top or 0, total or 0


def ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, limit: int | None = None, largest: int | None = None, **specs: Spec
) -> DataFrame:
    """Add one column per spec, computed over ``keys`` in ascending ``order``.

    ``order`` must be a total order within a key where ties would matter. Results do not
    depend on which of the two plans runs. ``largest`` is the size of the largest key where a
    caller has measured it already (a bound is enough), which saves the counting pass.
    """
    limit = limit or rows_per_task(df.sparkSession)
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        return _by_key(df, keys, order, specs)
    return _by_chunk(df, keys, order, specs)


def _window(columns: Sequence[str], order: Sequence[str]):
    """The window in ascending order and in the reverse of it."""
    by = Window.partitionBy(*([F.col(c) for c in columns] or [F.lit(0)]))
    return by.orderBy(*[F.col(o).asc_nulls_first() for o in order]), by.orderBy(*[F.col(o).desc_nulls_last() for o in order])


def _local(spec: Spec, windows) -> Column:
    """The spec inside one window partition; row neighbours come wrapped in a struct.

    Looking ahead is looking back in reverse: a frame that ends with the partition is read anew for each row.
    """
    w, reverse = windows
    to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if isinstance(spec, Prev):
        return F.lag(F.struct(spec.value.alias("v"))).over(w)
    if isinstance(spec, Next):
        return F.lead(F.struct(spec.value.alias("v"))).over(w)
    if type(spec) in RUNNING:
        return RUNNING[type(spec)][0](spec.value).over(to_here)
    if isinstance(spec, LastKnown):
        return F.last(spec.value, ignorenulls=True).over(to_here)
    return F.last(spec.value, ignorenulls=True).over(from_here)


def _by_key(df, keys, order, specs) -> DataFrame:
    w = _window(keys, order)
    out = {}
    for name, spec in specs.items():
        value = _local(spec, w)
        out[name] = value.getField("v") if isinstance(spec, Prev | Next) else value
    return df.withColumns(out)


def _summary(spec: Spec, rank: Column) -> Column:
    """What one chunk passes on to its neighbours."""
    if isinstance(spec, Prev):
        return F.max_by(F.struct(spec.value.alias("v")), rank)
    if isinstance(spec, Next):
        return F.min_by(F.struct(spec.value.alias("v")), rank)
    if type(spec) in RUNNING:
        return RUNNING[type(spec)][0](spec.value)
    known = F.when(spec.value.isNotNull(), rank)
    return F.max_by(spec.value, known) if isinstance(spec, LastKnown) else F.min_by(spec.value, known)


def _carry(spec: Spec, name: str, w) -> Column:
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    if isinstance(spec, Prev):
        return F.lag(name).over(w)
    if isinstance(spec, Next):
        return F.lead(name).over(w)
    if type(spec) in RUNNING:
        return RUNNING[type(spec)][0](name).over(before)
    if isinstance(spec, LastKnown):
        return F.last(name, ignorenulls=True).over(before)
    return F.first(name, ignorenulls=True).over(after)


def _by_chunk(df, keys, order, specs) -> DataFrame:
    n = max(2, shuffle_partitions(df.sparkSession))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    staged = materialise(df.repartitionByRange(n, *by).withColumn(CHUNK, F.spark_partition_id()))
    rank = F.struct(*order)
    parts = staged.groupBy(CHUNK, *keys).agg(*[_summary(s, rank).alias(k) for k, s in specs.items()])
    same_key = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    spanning = parts.withColumn("_chunks_of_key", F.count(F.lit(1)).over(same_key)).where("_chunks_of_key > 1")
    w = same_key.orderBy(CHUNK)
    carry = spanning.select(
        F.col(CHUNK).alias("_carry_chunk"),
        *[F.col(k).alias(f"_carry_key{i}") for i, k in enumerate(keys)],
        *[_carry(s, k, w).alias(f"_carry_{k}") for k, s in specs.items()],
    )
    on = F.col(CHUNK) == F.col("_carry_chunk")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_carry_key{i}"))
    local = _window([CHUNK, *keys], order)
    out = staged.withColumns({f"_local_{k}": _local(s, local) for k, s in specs.items()})
    # Bounded: at most two straddling keys per chunk.
    out = out.join(F.broadcast(carry), on, "left")
    for name, spec in specs.items():
        here, past = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if type(spec) in RUNNING:
            value = F.when(past.isNull(), here).when(here.isNull(), past).otherwise(RUNNING[type(spec)][1](here, past))
        else:
            value = F.coalesce(here, past)
        out = out.withColumn(name, value.getField("v") if isinstance(spec, Prev | Next) else value)
    return out.select(*df.columns, *specs)
