"""Column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
SPACES = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5


def plain(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names; others can't clash with what follows."""
    return docs.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def windows(n: Column, width: int, make, kind: str) -> Column:
    """``make(i)`` for every start ``i`` of a window of ``width`` among ``n`` items; none if there are too few."""
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), make)).otherwise(F.array().cast(f"array<{kind}>"))


def number(key: Column, salt: str = "", digits: int = 12) -> Column:
    """A whole number below 16**digits from the md5 of a key; any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key).cast("binary")), 1, digits), 16, 10).cast("long")
