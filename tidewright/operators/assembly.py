"""Joins and small filters that put a sample table together and refuse inputs that don't fit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import DAY_US, duration_us, micros
from .skew import salted_join


def refuse(problems: Mapping[str, int | None]) -> None:
    """Raises if any count isn't zero, naming all of them."""
    found = [f"{what}: {n}" for what, n in problems.items() if n]
    if found:
        raise ValueError("; ".join(found))


def repeated(df: DataFrame, keys: Sequence[str]) -> int:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()


def attach_outer(inner: DataFrame, outer: DataFrame, key: str, *, pair: str, fold: str, keep: Sequence[str]) -> DataFrame:
    """Inner predictions with the ``keep`` columns of the outer table.

    The outer table has one row for each key, and its fold must be one of the two that the inner
    model's pair holds out (``pair`` ends in their two digits); anything else is refused.
    """
    refuse({f"repeated {key} in the outer table": repeated(outer, [key])})
    out = salted_join(inner, outer.select(key, fold, *keep), [key], how="left")
    held = F.array(*[F.substring(pair, at, 1).cast("int") for at in (-2, -1)])
    refuse({"inner predictions outside the folds of their pair": out.where(~F.coalesce(F.array_contains(held, F.col(fold).cast("int")), F.lit(False))).count()})
    return out


def attach_wide(df: DataFrame, long: DataFrame, keys: Sequence[str], *, target: str, value: str, names: Mapping[str, str]) -> DataFrame:
    """The rows with one column for each target of a long table (target to new name); NULL where it has none."""
    wanted = long.where(F.col(target).isin(*names))
    refuse({"repeated targets of a key": repeated(wanted, [*keys, target])})
    columns = [F.max(F.when(F.col(target) == t, F.col(value))).alias(n) for t, n in names.items()]
    return salted_join(df, wanted.groupBy(*keys).agg(*columns), keys, how="left")


def in_both(a: DataFrame, b: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Rows of ``a`` and ``b`` with a key in both; columns in ``same`` must agree and appear once."""
    refuse({f"repeated {key}": repeated(a, [key]) + repeated(b, [key])})
    other = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in same], *[c for c in b.columns if c not in (key, *same)])
    both = a.join(other, key)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    refuse({f"pairs that disagree on {', '.join(same)}": both.where(differs).count()})
    return both.drop(*[f"_b_{c}" for c in same])


def wide_unique(long: DataFrame, keys: Sequence[str], column: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long records to one row for each key; two records for one cell are refused."""
    refuse({"cells with several records": repeated(long, [*keys, column])})
    return long.groupBy(*keys).pivot(column, list(names)).agg(F.first(value))


def days_between(ranges: DataFrame, first: str, last: str, *, before: int = 1) -> DataFrame:
    """``day``: every day of the ranges, each begun ``before`` days early."""
    return ranges.select(F.explode(F.sequence(F.date_sub(F.to_date(first), before), F.to_date(last))).alias("day")).distinct()


def outside_days(df: DataFrame, time: str, days: DataFrame) -> DataFrame:
    """Rows on none of the days."""
    return df.withColumn("_day", F.to_date(time)).join(days.withColumnRenamed("day", "_day"), "_day", "left_anti").drop("_day")


def known_missing(ledger: DataFrame, url: str, status: str, codes: Sequence[int] = (404, 410)) -> DataFrame:
    """Addresses that were answered with "no such file", which need not be asked for again."""
    return ledger.where(F.col(status).isin(*codes)).select(url).distinct()


def half_open(time: Column, start: str, end: str) -> Column:
    """Whether a time is in ``[start, end)``."""
    low, high = (micros(F.lit(x).cast("timestamp")) for x in (start, end))
    return (micros(time) >= low) & (micros(time) < high)


def age_counts(df: DataFrame, time: str, now: Column, max_age: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rows, too_old, youngest_days): rows older than ``max_age`` at ``now``; a row without a time is never too old."""
    age = micros(now) - micros(time)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(age > duration_us(max_age)).alias("too_old"), (F.min(age) / DAY_US).alias("youngest_days"))


def check_age(df: DataFrame, time: str, now: Column, max_age: str, allowed: int = 0) -> DataFrame:
    """The rows, unless more than ``allowed`` are older than ``max_age`` at ``now``."""
    old = age_counts(df, time, now, max_age).first()["too_old"]
    refuse({f"rows older than {max_age}": old if old > allowed else 0})
    return df


def years_in_all(df: DataFrame, by: str, time: str) -> DataFrame:
    """``year``: the years in which every value of ``by`` has rows."""
    seen = df.select(by, F.year(time).alias("year")).distinct()
    n = df.select(by).distinct().count()
    return seen.groupBy("year").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("year")
