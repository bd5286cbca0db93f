"""Audits of a split: shared groups, close neighbours in time, near-duplicate hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import US, duration_us
from ..functions.stats import seeded_hash
from ..session import materialise
from .align import pair_nearest
from .ordered import ordered, position
from .quantiles import quantiles
from .skew import salted_join
from .splits import TEST, TRAIN, VAL


def shared_groups(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """(column, value) for values in both test and (train or val)."""
    values = df.select(
        split, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]))
    ).withColumnsRenamed({"key": "column", "value": "group"})
    both = values.groupBy("column", "group").agg(
        F.max(F.col(split).isin(TRAIN, VAL)).alias("_a"), F.max(F.col(split) == TEST).alias("_b")
    )
    return both.where("_a and _b").select("column", "group")


def temporal_neighbours(
    df: DataFrame, *, time: str, min_gap: str | float, by: Sequence[str] = (), split: str = "split"
) -> DataFrame:
    """One row: test rows closer than ``min_gap`` to a train row of their group."""
    gap = duration_us(min_gap)
    test = df.where(F.col(split) == TEST).select(*by, time)
    train = df.where(F.col(split) == TRAIN).select(*by, time)
    near = pair_nearest(
        test, train, tolerance=max(gap - 1, 0) / US, by=by, target_time=time, reference_time=time
    )
    return near.agg(F.count("reference_us").alias("temporal_neighbours"))


def hamming(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.bit_count(a.bitwiseXOR(b))


def _bands(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n bands covering 64 bits."""
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


#: Bands that meet a larger share of all pairs than this save nothing: comparing numbers is far cheaper than joining rows.
DENSE = 0.005
#: Hashes of a side in one comparison, of the left side at a time, and pairs sent on at once.
BLOCK, STEP, SENT = 16_384, 8, 65_536


def _blocks(side: DataFrame, value: str, count: str, n: int, name: str) -> DataFrame:
    """(name, value, count): hashes and their counts as arrays of about ``BLOCK``."""
    rows = side.groupBy(F.pmod(F.xxhash64(value), F.lit(n)).alias(name)).agg(F.collect_list(F.struct(value, count)).alias("_s"))
    return rows.select(name, *[F.col(f"_s.{c}").alias(c) for c in (value, count)])


def _compare(max_hamming: int):
    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def batch(found):
            left, right, distance, pairs = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_pydict({
                "left_hash": left.view(np.int64), "right_hash": right.view(np.int64), "distance": pa.array(distance, pa.int32()), "n_pairs": pairs,
            })

        for rows in batches:
            for k in range(rows.num_rows):
                a, na, b, nb = (np.asarray(rows.column(c)[k].values) for c in ("left_hash", "_na", "right_hash", "_nb"))
                a, b, found, n = a.view(np.uint64), b.view(np.uint64), [], 0
                for start in range(0, len(a), STEP):
                    bits = np.bitwise_count(a[start : start + STEP, None] ^ b[None, :])
                    i, j = np.nonzero(bits <= max_hamming)
                    if len(i):
                        found.append((a[start + i], b[j], bits[i, j], na[start + i] * nb[j]))
                        n += len(i)
                    if n >= SENT:
                        yield batch(found)
                        found, n = [], 0
                if found:
                    yield batch(found)

    return compare


def _all_pairs(a: DataFrame, b: DataFrame, max_hamming: int) -> DataFrame:
    """The pairs of two tables of distinct hashes, every block of the one compared with every block of the other."""
    a, b = materialise(a), materialise(b)
    n, m = (max(1, -(-x.count() // BLOCK)) for x in (a, b))
    left = _blocks(a, "left_hash", "_na", n, "_i").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))))
    right = _blocks(b, "right_hash", "_nb", m, "_j").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    # A task has a few comparisons, whatever Spark makes of their size in bytes.
    both = left.repartition(n * m, "_i", "_j").hint("merge").join(right.repartition(n * m, "_i", "_j"), ["_i", "_j"])
    return both.select("left_hash", "_na", "right_hash", "_nb").mapInArrow(_compare(max_hamming), "left_hash long, right_hash long, distance int, n_pairs long")


def near_duplicates(
    left: DataFrame, right: DataFrame, column: str, *, max_hamming: int = 4, bands: int = 3, limit=None
) -> DataFrame:
    """Distinct hash pairs within ``max_hamming`` bits: ``left_hash, right_hash, distance, n_pairs``.

    Copies are counted first, so a group of equal hashes is one row on each side and
    ``n_pairs`` multiplies the counts. Of ``bands`` bands at least one differs in at most
    ``max_hamming // bands`` bits (pigeonhole), so one side probes its own value and those few
    neighbours. A pair is kept in its first qualifying band only; the result is exact. Where so many hashes share a
    neighbour that the bands would meet a good part of all pairs, blocks of hashes are compared instead, all with all.
    """
    radius = max_hamming // bands
    a = left.groupBy(F.col(column).alias("left_hash")).agg(F.count(F.lit(1)).alias("_na"))
    b = right.groupBy(F.col(column).alias("right_hash")).agg(F.count(F.lit(1)).alias("_nb"))
    a, b = a.where("left_hash is not null"), b.where("right_hash is not null")
    layout = _bands(bands)
    if sum(sum(comb(w, r) for r in range(radius + 1)) / 2**w for _, w in layout) > DENSE:
        return _all_pairs(a, b, max_hamming)
    masks = [_signed(((1 << w) - 1) << s) for s, w in layout]

    def band_value(h: str, i: int) -> Column:
        return F.shiftrightunsigned(F.col(h).bitwiseAND(F.lit(masks[i]).cast("bigint")), layout[i][0])

    def flips(i: int) -> Column:
        width = layout[i][1]
        near = [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(width), r)]
        return F.array(*[F.lit(x).cast("bigint") for x in near])

    def probe(i: int) -> Column:
        value = band_value("left_hash", i)
        return F.transform(flips(i), lambda f: F.struct(F.lit(i).alias("band"), value.bitwiseXOR(f).alias("v")))

    probes = F.flatten(F.array(*[probe(i) for i in range(bands)]))
    own = F.array(
        *[F.struct(F.lit(i).alias("band"), band_value("right_hash", i).alias("v")) for i in range(bands)]
    )
    pairs = salted_join(
        a.select("left_hash", "_na", F.inline(probes)), b.select("right_hash", "_nb", F.inline(own)),
        ["band", "v"], limit=limit,
    )
    diff = F.col("left_hash").bitwiseXOR(F.col("right_hash"))
    close = [F.bit_count(diff.bitwiseAND(F.lit(m).cast("bigint"))) <= radius for m in masks]
    first = reduce(lambda acc, i: F.when(close[i], i).otherwise(acc), range(bands - 1, -1, -1), F.lit(-1))
    return (
        pairs.where((F.bit_count(diff) <= max_hamming) & (F.col("band") == first))
        .select(
            "left_hash", "right_hash", F.bit_count(diff).alias("distance"), (F.col("_na") * F.col("_nb")).alias("n_pairs")
        )
    )


def leakage_report(
    df: DataFrame,
    *,
    groups: Sequence[str] = (),
    time: str | None = None,
    by: Sequence[str] = (),
    min_gap: str | float = 0,
    hash_column: str | None = None,
    max_hamming: int = 4,
    split: str = "split",
) -> DataFrame:
    """One row: shared group values, temporal neighbours, near-duplicate pairs, and ``ok``."""
    spark = df.sparkSession
    zero = spark.range(1)
    shared = shared_groups(df, groups, split).agg(F.count(F.lit(1)).alias("shared_groups")) if groups else (
        zero.select(F.lit(0).cast("bigint").alias("shared_groups"))
    )
    near = (
        temporal_neighbours(df, time=time, min_gap=min_gap, by=by, split=split)
        if time and duration_us(min_gap) > 0
        else zero.select(F.lit(0).cast("bigint").alias("temporal_neighbours"))
    )
    if hash_column:
        parts = [df.where(F.col(split) == s).select(hash_column) for s in (TEST, TRAIN)]
        dup = near_duplicates(*parts, hash_column, max_hamming=max_hamming).agg(
            F.coalesce(F.sum("n_pairs"), F.lit(0)).cast("bigint").alias("near_duplicate_pairs")
        )
    else:
        dup = zero.select(F.lit(0).cast("bigint").alias("near_duplicate_pairs"))
    # Three one-row tables side by side.
    one = shared.withColumn("_1", F.lit(1)).join(near.withColumn("_1", F.lit(1)), "_1")
    one = one.join(dup.withColumn("_1", F.lit(1)), "_1").drop("_1")
    total = F.col("shared_groups") + F.col("temporal_neighbours") + F.col("near_duplicate_pairs")
    return one.withColumn("ok", total == 0)


def adjacent_days(df: DataFrame, day: str, split: str = "split") -> DataFrame:
    """One row: distinct test days that are a train day or next to one."""
    test = df.where(F.col(split) == TEST).select(F.to_date(day).alias("d")).distinct()
    train = df.where(F.col(split) == TRAIN).select(F.to_date(day).alias("d")).distinct()
    around = train.select(F.explode(F.array(F.date_sub("d", 1), "d", F.date_add("d", 1))).alias("d"))
    return test.join(around, "d", "left_semi").agg(F.count(F.lit(1)).alias("adjacent_days"))


def random_pair_distances(
    df: DataFrame, *, by: str, day: str, hashes: str, order: Sequence[str], pairs: int = 20_000, seed: int = 0, near: int = 4,
    probs: dict[str, float] | None = None, limit: int | None = None,
) -> DataFrame:
    """(by, pairs, q05, q50, q95, near_share) of bit distances between random rows of a camera on different days.

    Both rows of a pair are numbers drawn by hash and looked up by their place in ``order``, so rows never meet all
    others. Pairs on one day are dropped after the draw, as are rows without a hash before it.
    """
    probs = probs or {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    rows = df.where(F.col(hashes).isNotNull()).select(by, *[c for c in order if c != by], F.col(day).alias("_day"), F.col(hashes).alias("_hash"))
    placed = ordered(rows, [by], list(order), limit=limit, _place=position()).select(by, (F.col("_place") - 1).alias("_place"), "_day", "_hash")
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    drawn = sizes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    drawn = drawn.select(by, *[F.pmod(seeded_hash(seed, side, by, "_k"), F.col("_n")).alias(f"_{name}") for name, side in (("i", F.lit("i")), ("j", F.lit("j")))])
    first = placed.select(by, F.col("_place").alias("_i"), F.col("_day").alias("_d1"), F.col("_hash").alias("_h1"))
    second = placed.select(by, F.col("_place").alias("_j"), F.col("_day").alias("_d2"), F.col("_hash").alias("_h2"))
    met = drawn.join(first, [by, "_i"]).join(second, [by, "_j"]).where("_d1 <> _d2").select(by, hamming("_h1", "_h2").alias("distance"))
    shares = met.groupBy(by).agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("distance") <= near).cast("double")).alias("near_share"))
    return shares.join(quantiles(met, [by], "distance", probs, limit=limit), by)
