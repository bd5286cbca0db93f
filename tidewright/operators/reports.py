"""Reports by stratum with intervals over whole units (days, stations, groups): classes, and arms against controls.

A stratum is a combination of the ``by`` columns, none of them NULL. Rows become one row of sums for each unit of a
stratum; draws are made for all strata in one pass, each unit row making its own draw in every replicate, so the work
is units x replicates rows spread over all tasks, and no stratum or unit is ever one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import divide, finite
from ..functions.stats import seeded_hash
from ..session import materialise
from .assembly import refuse
from .ordered import ordered, position
from .skew import salted_join

HEADLINE = ("balanced_accuracy", "f1_macro", "quadratic_weighted_kappa", "within_one_accuracy", "accuracy")
ALL = "_all"


def resample_strata(stats: DataFrame, by: Sequence[str], unit: str, sums: Sequence[str], *, replicates: int, seed: int = 0) -> DataFrame:
    """(by..., replicate, sums...): as many units of each stratum as it has, drawn with replacement.

    Draw d of a replicate is the same number in every stratum, taken modulo the stratum's units, and units are
    numbered in their order; so strata with the same units are resampled alike.
    """
    by = list(by)
    numbered = materialise(ordered(stats, by, [unit], _pos=position()).withColumn("_i", F.col("_pos") - 1).drop("_pos"))
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    own = salted_join(numbered.select(*by, F.col("_i").alias("_d")), sizes, by, how="left")
    drawn = own.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    picked = drawn.groupBy(*by, "replicate", F.pmod(seeded_hash(seed, "replicate", "_d"), F.col("_k")).alias("_i")).agg(F.count(F.lit(1)).alias("_times"))
    return picked.join(numbered, [*by, "_i"]).groupBy(*by, "replicate").agg(*[F.sum(F.col(s) * F.col("_times")).alias(s) for s in sums])


def intervals(reps: DataFrame, by: Sequence[str], values: Mapping[str, Column], alpha: float) -> DataFrame:
    """``<name>_lo`` and ``<name>_hi`` for each stratum; replicates in which a value is undefined are left out of it."""
    ends = {"lo": alpha / 2, "hi": 1 - alpha / 2}
    return reps.groupBy(*by).agg(*[F.percentile(v, p).alias(f"{name}_{end}") for name, v in values.items() for end, p in ends.items()])


def headline(cells: Sequence[Sequence[str]]) -> dict[str, Column]:
    """The headline scores from the columns that count each (true, predicted) cell."""
    k = range(len(cells))
    c = [[F.col(name).cast("double") for name in row] for row in cells]
    support = [reduce(add, c[i]) for i in k]
    predicted = [reduce(add, [c[i][j] for i in k]) for j in k]
    n = reduce(add, support)
    recalls = [divide(c[i][i], support[i]) for i in k]
    seen = [(support[i] + predicted[i] > 0) for i in k]
    f1 = [F.coalesce(divide(2 * c[i][i], support[i] + predicted[i]), F.lit(0.0)) for i in k]
    mean = lambda xs, counted: divide(reduce(add, [F.coalesce(x, F.lit(0.0)) for x in xs]), reduce(add, [t.cast("double") for t in counted]))
    weighted = lambda w: reduce(add, [w(i, j) * c[i][j] for i in k for j in k])
    chance = divide(reduce(add, [(i - j) ** 2 * support[i] * predicted[j] for i in k for j in k]), n)
    return {
        "balanced_accuracy": mean(recalls, [s > 0 for s in support]),
        "f1_macro": mean(f1, seen),
        "quadratic_weighted_kappa": F.when(chance > 1e-12, 1 - weighted(lambda i, j: (i - j) ** 2) / chance),
        "within_one_accuracy": divide(weighted(lambda i, j: int(abs(i - j) <= 1)), n),
        "accuracy": divide(weighted(lambda i, j: int(i == j)), n),
    }


def class_report(
    df: DataFrame, true: str, pred: str, k: int, *, unit: str, by: Sequence[str] = (), near: str | None = None,
    replicates: int = 1000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """One row for each stratum, from its rows with a true class of 0 to k - 1.

    ``n`` counts those that are predicted (a class of 0 to k - 1), ``coverage`` is their share, ``n_units`` their
    units. ``confusion`` holds the cells row by row, ``support`` and ``support_units`` the rows and units of each true
    class. Every headline score comes with the interval of resampled units, and as ``<score>_clear`` without the rows
    that ``near`` marks: NULL unless a stratum has both kinds. A stratum without a predicted row keeps its row, with
    NULL scores. Rows without a unit are one unit together.
    """
    keys = list(by) or [ALL]
    rows = df if by else df.withColumn(ALL, F.lit(1))
    rows = rows.where(F.col(true).between(0, k - 1)).withColumn("_unit", F.coalesce(F.col(unit).cast("string"), F.lit("")))
    hit = F.coalesce(F.col(pred).between(0, k - 1), F.lit(False))
    cell = F.when(hit, F.col(true).cast("int") * k + F.col(pred).cast("int"))
    close = F.coalesce(F.col(near), F.lit(False)) if near else F.lit(False)
    whole = [[f"c{i}_{j}" for j in range(k)] for i in range(k)]
    clear = [[f"w{i}_{j}" for j in range(k)] for i in range(k)]
    counts = [F.count_if(cell == i * k + j).alias(whole[i][j]) for i in range(k) for j in range(k)]
    counts += [F.count_if((cell == i * k + j) & ~close).alias(clear[i][j]) for i in range(k) for j in range(k)]
    stats = materialise(rows.groupBy(*keys, "_unit").agg(*counts, F.count(F.lit(1)).alias("_rows"), F.count(cell).alias("_n")))

    names, support = [x for row in whole for x in row], [reduce(add, [F.col(x) for x in row]) for row in whole]
    cells = [*names, *[x for row in clear for x in row]]
    total = stats.groupBy(*keys).agg(
        *[F.sum(x).alias(x) for x in cells], F.sum("_n").alias("n"), F.sum("_rows").alias("_rows"), F.count_if(F.col("_n") > 0).alias("n_units"),
        F.array(*[F.count_if(s > 0) for s in support]).alias("support_units"),
    )
    n_clear = reduce(add, [F.col(x) for row in clear for x in row])
    both = (n_clear > 0) & (n_clear < F.col("n"))
    point = total.select(
        *keys, "n", "n_units", (F.col("n") / F.col("_rows")).alias("coverage"), F.array(*names).alias("confusion"), F.array(*support).alias("support"), "support_units",
        F.when(both, n_clear).alias("n_clear"), *[v.alias(m) for m, v in headline(whole).items()],
        *[F.when(both, v).alias(f"{m}_clear") for m, v in headline(clear).items()],
    )
    reps = resample_strata(stats.where("_n > 0"), keys, "_unit", names, replicates=replicates, seed=seed)
    ends = intervals(reps, keys, headline(whole), alpha)
    return point.join(ends, keys, "left").drop(ALL)


def baseline_reports(
    df: DataFrame, true: str, k: int, *, unit: str, splits: Mapping[str, str], baselines: Mapping[str, Mapping[str, str]],
    parts: Sequence[str] = ("val", "test", "test_later"), near: str | None = None, replicates: int = 1000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """:func:`class_report` by ``split, part, baseline`` for all of them in one pass.

    ``splits`` names the column of parts of each split, ``baselines`` the column of predicted classes of each baseline
    under each split. A row becomes splits x baselines short rows that are added up before they are shuffled.
    """
    arms = [
        F.struct(F.lit(s).alias("split"), F.col(part).alias("part"), F.lit(b).alias("baseline"), F.col(columns[s]).cast("int").alias("_pred"))
        for s, part in splits.items() for b, columns in baselines.items() if s in columns
    ]
    long = df.select(true, F.col(unit).alias("_u"), (F.col(near) if near else F.lit(False)).alias("_near"), F.inline(F.array(*arms)))
    long = long.where(F.col("part").isin(list(parts)))
    return class_report(long, true, "_pred", k, unit="_u", by=["split", "part", "baseline"], near="_near", replicates=replicates, alpha=alpha, seed=seed)


def check_scored(df: DataFrame, row_id: str, columns: Sequence[str]) -> None:
    """Raises unless every row has all numbers and ids occur once."""
    gap = reduce(lambda a, b: a | b, [finite(c).isNull() for c in columns])
    found = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("gaps")).agg(
        F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("incomplete")
    ).first()
    refuse({f"{row_id} more than once": found["repeated"], "rows without a number": found["incomplete"]})


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = df.withColumns({c: finite(c) for c in columns})
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def contrasts(
    df: DataFrame, true: str, candidate: str, controls: Sequence[str], *, unit: str, by: Sequence[str] = (), equal_units: bool = False,
    replicates: int = 2000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """(by..., control, rows, units, rmse_candidate, rmse_control, delta, delta_lo, delta_hi, met), one row for each control.

    All controls share the draws. ``equal_units`` averages the units' mean squared errors instead of pooling rows.
    ``met``: the whole interval of candidate minus control lies below zero. Rows without the truth or any arm are left out.
    """
    keys = list(by) or [ALL]
    arms = [candidate, *controls]
    rows = _complete(df if by else df.withColumn(ALL, F.lit(1)), [true, *arms]).withColumn("_unit", F.coalesce(F.col(unit).cast("string"), F.lit("")))
    error = lambda a: F.sum((F.col(a) - F.col(true)) * (F.col(a) - F.col(true)))
    names = [f"e{i}" for i, _ in enumerate(arms)]
    stats = materialise(rows.groupBy(*keys, "_unit").agg(F.count(F.lit(1)).alias("rows"), *[error(a).alias(e) for a, e in zip(arms, names, strict=True)]))
    weight = F.lit(1.0) if equal_units else F.col("rows").cast("double")
    share = F.col("rows") if equal_units else F.lit(1.0)
    stats = stats.select(*keys, "_unit", "rows", weight.alias("w"), *[(F.col(e) / share).alias(e) for e in names])
    rmse = lambda e: F.sqrt(F.col(e) / F.col("w"))
    point = stats.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("units"), *[F.sum(x).alias(x) for x in ("w", *names)])
    reps = resample_strata(stats, keys, "_unit", ["w", *names], replicates=replicates, seed=seed)
    ends = intervals(reps, keys, {e: rmse("e0") - rmse(e) for e in names[1:]}, alpha)
    each = [
        F.struct(F.lit(c).alias("control"), rmse("e0").alias("rmse_candidate"), rmse(e).alias("rmse_control"), (rmse("e0") - rmse(e)).alias("delta"),
                 F.col(f"{e}_lo").alias("delta_lo"), F.col(f"{e}_hi").alias("delta_hi"))
        for c, e in zip(controls, names[1:], strict=True)
    ]
    out = point.join(ends, keys).select(*keys, "rows", "units", F.inline(F.array(*each)))
    return out.withColumn("met", F.col("delta_hi") < 0).drop(ALL)


def endpoint_summary(
    df: DataFrame, true: str, candidate: str, controls: Sequence[str], *, by: Sequence[str], group: str, station: str,
    replicates: int = 2000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """:func:`contrasts` weighted three ways (``weighting``): rows by group, rows by station, groups alike."""
    ways = {"by_group": (group, False), "by_station": (station, False), "equal_group": (group, True)}
    parts = [
        contrasts(df, true, candidate, controls, unit=u, by=by, equal_units=e, replicates=replicates, alpha=alpha, seed=seed).withColumn("weighting", F.lit(w))
        for w, (u, e) in ways.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def bar_met(summary: DataFrame, by: Sequence[str], control: str) -> DataFrame:
    """(by..., endpoints, bar_met): whether the contrast by group is met at every endpoint of the stratum."""
    chosen = summary.where((F.col("weighting") == "by_group") & (F.col("control") == control))
    return chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("endpoints"), F.bool_and("met").alias("bar_met"))


def registered_comparison(
    df: DataFrame, row_id: str, true: str, arms: Sequence[str], candidate: str, controls: Sequence[str], *, group: str, station: str,
    replicates: int = 2000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """One row: size of the scored population, pooled R2 of every arm (``r2_<arm>``), and the contrast with the first
    control, on which the claim rests. Incomplete or repeated rows are refused."""
    check_scored(df, row_id, [true, *arms])
    y = F.col(true)
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    r2 = {a: 1 - divide(F.sum((F.col(a) - y) * (F.col(a) - y)), spread) for a in arms}
    size = df.agg(F.count(F.lit(1)).alias("strips"), F.count_distinct(station).alias("stations"), F.count_distinct(group).alias("groups"), *[v.alias(f"r2_{a}") for a, v in r2.items()])
    primary = contrasts(df, true, candidate, controls[:1], unit=group, replicates=replicates, alpha=alpha, seed=seed)
    primary = primary.select(F.col("control").alias("primary_control"), "delta", "delta_lo", "delta_hi", F.col("met").alias("primary_met"))
    return size.withColumn(ALL, F.lit(1)).join(primary.withColumn(ALL, F.lit(1)), ALL).drop(ALL)


def arm_scorecard(df: DataFrame, true: str, arms: Sequence[str], thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., arm, n, bias, mae, rmse, r2, correlation, accuracy, within_one): regression scores and accuracies of
    the classes between the thresholds, all arms in one pass. Rows without the truth or the arm are left out of that arm."""
    long = df.select(*by, finite(true).alias("_y"), F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), finite(a).alias("_p")) for a in arms])))
    y, p = F.col("_y"), F.col("_p")
    bin_of = lambda v: reduce(add, [(v >= t).cast("int") for t in thresholds])
    gap, step, n = p - y, F.abs(bin_of(p) - bin_of(y)), F.count(F.lit(1))
    return long.where("_y is not null and _p is not null").groupBy(*by, "arm").agg(
        n.alias("n"), F.avg(gap).alias("bias"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (1 - divide(F.sum(gap * gap), F.var_pop(y) * n)).alias("r2"), F.corr(y, p).alias("correlation"),
        (F.count_if(step == 0) / n).alias("accuracy"), (F.count_if(step <= 1) / n).alias("within_one"),
    )
