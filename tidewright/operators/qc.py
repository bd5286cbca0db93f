"""Quality flags. Tests annotate rows and never remove them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import waves
from ..functions.angles import fourier_from_polar
from ..functions.base import US, ColumnLike, col, duration_us, finite, micros
from ..session import rows_per_task
from .ordered import LastKnown, Prev, RunningSum, largest_group, ordered, position

# Primary flags, and their order of precedence from weakest to strongest.
PASS, NOT_EVALUATED, SUSPECT, FAIL, MISSING = 1, 2, 3, 4, 9
PRECEDENCE = (NOT_EVALUATED, PASS, SUSPECT, FAIL, MISSING)
FLAG_NAMES = {1: "PASS", 2: "NOT_EVALUATED", 3: "SUSPECT", 4: "FAIL", 9: "MISSING"}

Span = tuple[float, float]

#: Relative error that a mean of doubles may carry.
ROUNDING = 1e-9


def _outside(v: Column, span: Span) -> Column:
    return (v < span[0]) | (v > span[1])


def flag_rank(flag: ColumnLike) -> Column:
    """Position of a flag in the order of precedence."""
    return F.array_position(F.array(*[F.lit(f) for f in PRECEDENCE]), col(flag).cast("int")) - 1


def flag_of_rank(rank: ColumnLike) -> Column:
    flags = F.array(*[F.lit(f) for f in PRECEDENCE])
    return F.element_at(flags, (col(rank) + 1).cast("int")).cast("tinyint")


def combine(*flags: ColumnLike) -> Column:
    """Row-wise combination: MISSING over FAIL over SUSPECT over PASS over NOT_EVALUATED."""
    ranks = [flag_rank(f) for f in flags]
    return flag_of_rank(ranks[0] if len(ranks) == 1 else F.greatest(*ranks))


def worst(flag: ColumnLike) -> Column:
    """The same combination as an aggregate over long (row, test, flag) tables."""
    return flag_of_rank(F.max(flag_rank(flag)))


def gross_range(value: ColumnLike, fail: Span, suspect: Span | None = None) -> Column:
    v = finite(value)
    out = F.when(v.isNull(), MISSING).when(_outside(v, fail), FAIL)
    if suspect is not None:
        out = out.when(_outside(v, suspect), SUSPECT)
    return out.otherwise(PASS).cast("tinyint")


def propagate_height_failure(height_flag: ColumnLike, flag: ColumnLike) -> Column:
    """A failed height fails every other parameter of the record that is present."""
    f = col(flag)
    return F.when((col(height_flag) == FAIL) & (f != MISSING), FAIL).otherwise(f).cast("tinyint")


def operational_frequency(frequency: ColumnLike, instrument: Span, local: Span | None = None) -> Column:
    return gross_range(frequency, instrument, local)


def neighbour(value: ColumnLike, other: ColumnLike, max_delta: float) -> Column:
    a, b = finite(value), finite(other)
    return (
        F.when(a.isNull(), MISSING)
        .when(b.isNull(), NOT_EVALUATED)
        .when(F.abs(a - b) > max_delta, SUSPECT)
        .otherwise(PASS)
        .cast("tinyint")
    )


def steepness(height, period, suspect_above=0.07, fail_above=waves.MICHELL_STEEPNESS) -> Column:
    h, t = finite(height), finite(period)
    s = waves.steepness(h, F.when(t > 0, t))
    return (
        F.when(s.isNull(), MISSING)
        .when(s > fail_above, FAIL)
        .when(s > suspect_above, SUSPECT)
        .otherwise(PASS)
        .cast("tinyint")
    )


def spectral_consistency(reported, spectral, abs_tol=0.1, rel_tol=0.1) -> Column:
    a, b = finite(reported), finite(spectral)
    tol = F.greatest(F.lit(abs_tol), rel_tol * F.abs(a))
    return (
        F.when(a.isNull() | b.isNull(), NOT_EVALUATED)
        .when(F.abs(a - b) > tol, SUSPECT)
        .otherwise(PASS)
        .cast("tinyint")
    )


def directional_moments(alpha1, alpha2, r1, r2) -> Column:
    """Range of the parameters, and |c2 - c1^2| <= 1 - |c1|^2 for a realisable pair."""
    x1, x2, q1, q2 = finite(alpha1), finite(alpha2), finite(r1), finite(r2)
    a1, b1, a2, b2 = fourier_from_polar(x1, x2, q1, q2)
    excess = F.hypot(a2 - (a1 * a1 - b1 * b1), b2 - 2 * a1 * b1) - (1 - (a1 * a1 + b1 * b1))
    bad = _outside(q1, (0, 1)) | _outside(q2, (0, 1)) | _outside(x1, (0, 360)) | _outside(x2, (0, 360))
    gone = x1.isNull() | x2.isNull() | q1.isNull() | q2.isNull()
    return (
        F.when(gone, MISSING).when(bad, FAIL).when(excess > 1e-9, SUSPECT).otherwise(PASS).cast("tinyint")
    )


def low_frequency_energy(spectra: DataFrame, record: Sequence[str], f_cutoff: float, span: Span) -> DataFrame:
    """SUSPECT records whose energy below the cutoff is outside the span."""
    s = finite("spectral_density_m2_hz")
    low = F.sum(F.when(F.col("frequency_hz") < f_cutoff, s * F.col("bandwidth_hz")))
    e = F.coalesce(low, F.lit(0.0))
    flag = F.when(F.count(s) == 0, MISSING).when(_outside(e, span), SUSPECT).otherwise(PASS)
    return spectra.groupBy(*record).agg(e.alias("low_energy"), flag.cast("tinyint").alias("flag"))


def provider_flag(flag: ColumnLike) -> Column:
    """Leading number of a provider flag such as ``1/0``; unknown values are not evaluated."""
    lead = F.split(col(flag), "/")[0].try_cast("int")
    return F.when(lead.isin(*FLAG_NAMES), lead).otherwise(NOT_EVALUATED).cast("tinyint")


def flag_counts(df: DataFrame, tests: Sequence[str]) -> DataFrame:
    """Rows per (test, flag name) of a wide flag table."""
    names = F.create_map(*[F.lit(x) for pair in FLAG_NAMES.items() for x in pair])
    long = df.select(F.explode(F.create_map(*[x for t in tests for x in (F.lit(t), F.col(t))])))
    return (
        long.groupBy(F.col("key").alias("test"), names[F.col("value").cast("int")].alias("flag_name"))
        .count()
        .withColumnRenamed("count", "n")
    )


def gap_and_rate(
    df: DataFrame,
    *,
    by: Sequence[str],
    time: str,
    value: str,
    tie: str,
    expected_s: float,
    max_change: float,
    tolerance: float = 0.5,
    per_seconds: float | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``gap_flag`` and ``rate_flag`` from the previous record, in one scan.

    Gap: SUSPECT after more than ``expected_s * (1 + tolerance)``, FAIL without an increase.
    Rate: FAIL for a change above ``max_change``, optionally per ``per_seconds`` of the actual
    spacing (at least one second). A missing previous value means no test.
    """
    seen = ordered(
        df.withColumn("_us", micros(time)).withColumn("_v", finite(value)),
        by,
        ["_us", tie],
        limit=limit,
        _p=Prev(F.struct("_us", "_v")),
    )
    dt = (F.col("_us") - F.col("_p._us")) / US
    change = F.abs(F.col("_v") - F.col("_p._v"))
    allowed = F.lit(float(max_change))
    if per_seconds is not None:
        allowed = max_change * F.greatest(dt, F.lit(1.0)) / per_seconds
    gap = F.when(dt <= 0, FAIL).when(dt > expected_s * (1 + tolerance), SUSPECT).otherwise(PASS)
    rate = F.when(F.col("_v").isNull(), MISSING).when(change > allowed, FAIL).otherwise(PASS)
    return seen.withColumns(
        {"gap_flag": gap.cast("tinyint"), "rate_flag": rate.cast("tinyint")}
    ).drop("_us", "_v", "_p")


def flat_line(
    df: DataFrame,
    *,
    by: Sequence[str],
    time: str,
    value: str,
    tie: str,
    suspect_count: int = 3,
    fail_count: int = 5,
    tolerance: float = 1e-6,
    limit: int | None = None,
    output: str = "flat_flag",
) -> DataFrame:
    """Runs of successive values equal within ``tolerance``; zero never fails, a gap breaks a run."""
    limit = limit or rows_per_task(df.sparkSession)
    base = df.withColumn("_us", micros(time)).withColumn("_v", finite(value))
    largest = largest_group(base, by)
    seen = ordered(base, by, ["_us", tie], limit=limit, largest=largest, _p=Prev(F.col("_v")), _n=position())
    same = F.coalesce(F.abs(F.col("_v") - F.col("_p")) <= tolerance, F.lit(False))
    seen = seen.withColumn("_start", F.when(~same, F.col("_n")))
    seen = ordered(seen, by, ["_us", tie], limit=limit, largest=largest, _first=LastKnown(F.col("_start")))
    run = F.col("_n") - F.col("_first") + 1
    flag = (
        F.when(F.col("_v").isNull(), MISSING)
        .when((run >= fail_count) & (F.col("_v") != 0), FAIL)
        .when(run >= suspect_count, SUSPECT)
        .otherwise(PASS)
    )
    return seen.withColumn(output, flag.cast("tinyint")).drop("_us", "_v", "_p", "_n", "_start", "_first")


#: Rows of the largest key up to which a window frame is added up anew for each row.
FRAME_ROWS = 20_000


def trailing_moments(
    df: DataFrame,
    *,
    by: Sequence[str],
    time: str,
    value: str,
    window: str | float,
    limit: int | None = None,
) -> DataFrame:
    """Count, mean and sample deviation of the values in ``[t - window, t)``: ``_n, _mu, _sd``.

    Small keys use a range frame, which adds up its window anew for every row. Above ``FRAME_ROWS`` rows
    of a key that would be quadratic: then it is running sums of values centred on the key's mean, read at ``t`` and at ``t - window``, so no task ever holds the key.
    """
    limit = limit or rows_per_task(df.sparkSession)
    w = duration_us(window)
    base = df.withColumn("_us", micros(time)).withColumn("_v", finite(value))
    if largest_group(base, by) <= min(limit, FRAME_ROWS):
        frame = (
            Window.partitionBy(*[F.col(b) for b in by] or [F.lit(0)]).orderBy("_us").rangeBetween(-w, -1)
        )
        v = F.col("_v")
        return base.withColumns(
            {
                "_n": F.count(v).over(frame),
                "_mu": F.avg(v).over(frame),
                "_sd": F.stddev_samp(v).over(frame),
            }
        ).drop("_us", "_v")

    from .skew import salted_join

    keys = [f"_k{i}" for i, _ in enumerate(by)] or ["_k0"]
    key_columns = {k: F.col(b) for k, b in zip(keys, by, strict=True)} if by else {"_k0": F.lit(0)}
    keyed = base.withColumns(key_columns)
    instants = keyed.groupBy(*keys, "_us").agg(
        F.count("_v").alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q")
    )
    centre = instants.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("_m"))
    c = salted_join(instants, centre, keys, how="left", limit=limit)
    s, n, m = F.coalesce("s", F.lit(0.0)), F.col("n"), F.coalesce("_m", F.lit(0.0))
    c = c.select(
        *keys, "_us", n.alias("n"), (s - n * m).alias("s"),
        (F.coalesce("q", F.lit(0.0)) - 2 * m * s + n * m * m).alias("q"), m.alias("m"),
    )
    zero = {"n": F.lit(0).cast("bigint"), "s": F.lit(0.0), "q": F.lit(0.0)}
    here = c.withColumns({"_at": F.col("_us"), "_side": F.lit(1)})
    edge = c.withColumns({"_at": F.col("_us"), "_us": F.col("_us") - w, "_side": F.lit(0)}).withColumns(zero)
    seen = ordered(
        here.unionByName(edge), keys, ["_us", "_side"], limit=limit,
        pn=RunningSum(F.col("n")), ps=RunningSum(F.col("s")), pq=RunningSum(F.col("q")),
    )
    sign = F.when(F.col("_side") == 1, 1).otherwise(-1)
    sums = seen.groupBy(*keys, F.col("_at").alias("_us")).agg(
        F.sum(sign * (F.col("pn") - F.col("n"))).alias("_n"),
        F.sum(sign * (F.col("ps") - F.col("s"))).alias("_s"),
        F.sum(sign * (F.col("pq") - F.col("q"))).alias("_q"),
        F.first("m").alias("_m"),
    )
    n = F.col("_n")
    mean = F.when(n > 0, F.col("_m") + F.col("_s") / n)
    var = F.when(n > 1, F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0)) / (n - 1))
    stats = sums.select(*keys, "_us", n, mean.alias("_mu"), F.sqrt(var).alias("_sd"))
    return salted_join(keyed, stats, [*keys, "_us"], how="left", limit=limit).drop(*keys, "_us", "_v")


def mean_std(
    df: DataFrame,
    *,
    by: Sequence[str],
    time: str,
    value: str,
    window: str | float = "24h",
    n_std: float = 3.0,
    min_periods: int = 6,
    limit: int | None = None,
    output: str = "mean_std_flag",
) -> DataFrame:
    """SUSPECT outside mean +/- n_std deviations of the preceding window.

    A difference from the mean below ``ROUNDING`` of the values is rounding of the mean, not a deviation;
    so a window of equal values passes values equal to them, whichever plan computed its moments.
    """
    seen = trailing_moments(df, by=by, time=time, value=value, window=window, limit=limit)
    v = finite(value)
    rounding = ROUNDING * F.greatest(F.abs(v), F.abs(F.col("_mu")))
    far = (F.col("_n") >= min_periods) & (F.abs(v - F.col("_mu")) > F.greatest(n_std * F.col("_sd"), rounding))
    flag = F.when(v.isNull(), MISSING).when(far, SUSPECT).otherwise(PASS)
    return seen.withColumn(output, flag.cast("tinyint")).drop("_n", "_mu", "_sd")
