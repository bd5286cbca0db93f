"""Placement of rows on shards by a lookup table that the shards fill in turns.

Every shard has its own order of preference over the slots of a prime-sized table (a start and a
step, both from the md5 of its name). Shards take turns; at its turn a shard claims the first slot
of its order that is still free. So all shards hold equally many slots but for one, and if a shard
goes, few keys move that weren't its own. The table has ``size`` rows, a parameter of the operator
that doesn't grow with the data, and is broadcast: one hash and one lookup place a row, without a
shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import number

#: The largest table that is broadcast, about 16 MB.
MAX_SLOTS = 1_000_003


def prime_from(n: int) -> int:
    """The smallest prime that is at least ``n``."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def preference(shard: str, size: int) -> tuple[int, int]:
    """Start and step of a shard's order over the slots; the step has no common divisor with the prime size."""
    draw = lambda salt: int(hashlib.md5(f"{salt}:{shard}".encode()).hexdigest()[:12], 16)
    return draw("start") % size, draw("step") % (size - 1) + 1


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard's number in every slot. Work is about size * ln(size) steps, whatever the data."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and distinct")
    if not len(shards) <= size <= MAX_SLOTS or prime_from(size) != size:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_SLOTS}")
    orders = [preference(s, size) for s in shards]
    slots, places, taken = [-1] * size, [start for start, _ in orders], 0
    while True:
        for k, (_, step) in enumerate(orders):
            while slots[places[k]] >= 0:
                places[k] = (places[k] + step) % size
            slots[places[k]] = k
            taken += 1
            if taken == size:
                return slots


def slot_rows(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """``slot, shard`` for the whole table."""
    text = ",".join(map(str, lookup_table(shards, size)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "k"))
    return rows.select("slot", F.element_at(F.array(*map(F.lit, shards)), F.col("k").cast("int") + 1).alias("shard"))


def place(docs: DataFrame, shards: list[str], size: int | None = None, key: str = "doc_id") -> DataFrame:
    """``key, slot, shard`` for every row.

    The table gets the smallest prime of at least 100 slots per shard unless ``size`` is given, so
    shares differ by less than 1 %. A null key is placed as the empty text; equal keys, repeated
    rows included, go to the same shard; an empty input gives an empty result.
    """
    size = size or prime_from(100 * len(shards))
    keyed = docs.select(F.col(f"`{key}`").alias("key"))
    keyed = keyed.withColumn("slot", (number(F.coalesce(F.col("key").cast("string"), F.lit(""))) % size).cast("int"))
    table = slot_rows(docs.sparkSession, shards, size)
    return keyed.join(F.broadcast(table), "slot").select(F.col("key").alias(key), "slot", "shard")


def moved(docs: DataFrame, before: list[str], after: list[str], size: int, key: str = "doc_id") -> DataFrame:
    """Rows per pair of shards before and after a change of the shard set, with one table size."""
    keyed = docs.select((number(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % size).cast("int").alias("slot"))
    old = slot_rows(docs.sparkSession, before, size).withColumnRenamed("shard", "shard_before")
    new = slot_rows(docs.sparkSession, after, size).withColumnRenamed("shard", "shard_after")
    both = F.broadcast(old.join(F.broadcast(new), "slot"))
    return keyed.join(both, "slot").groupBy("shard_before", "shard_after").agg(F.count("*").alias("n"))
