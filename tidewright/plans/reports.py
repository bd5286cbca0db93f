"""Queries of reports by stratum: classes with intervals by unit, arms against controls, registered comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, reports
from .registry import Tables, query, rounded, sql_r6

REPLICATES = 60
K = 4

#: Predicted classes of orders: from the price, moved by the key, missing for some customers.
SQL_CLASSES = """WITH o AS (SELECT *, CAST(least(floor(o_totalprice / 90000), 3) AS INT) AS a, o_orderkey % 6 = 0 AS near FROM orders),
    x AS (SELECT *, CASE WHEN o_custkey % 11 = 0 THEN -1 ELSE greatest(least(a + (o_orderkey % 5 = 0)::INT - (o_orderkey % 7 = 0)::INT, 3), 0) END AS p1,
      CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE 1 END AS p2 FROM o)"""


def classes(t: Tables) -> DataFrame:
    a = F.least(F.floor(F.col("o_totalprice") / 90000), F.lit(3)).cast("int")
    k = F.col("o_orderkey")
    moved = F.greatest(F.least(F.col("a") + (k % 5 == 0).cast("int") - (k % 7 == 0).cast("int"), F.lit(3)), F.lit(0))
    rows = t.orders.withColumns({"a": a, "near": k % 6 == 0, "unit": F.concat(F.lit("u"), (F.col("o_custkey") % 37).cast("string"))})
    return rows.withColumns({"p1": F.when(F.col("o_custkey") % 11 != 0, moved).otherwise(-1), "p2": F.when(k % 9 != 0, 1).otherwise(-1)})


def class_report_sql(rows: str, names: str) -> str:
    """The report over a table ``r`` of ``s, u, a, p, near``; ``names`` turns the stratum ``s`` into output columns."""
    heads = reports.HEADLINE
    return f"""{SQL_CLASSES}, r AS ({rows}), v AS (SELECT * FROM r WHERE p >= 0),
    us AS (SELECT s, u, row_number() OVER (PARTITION BY s ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY s) AS k FROM (SELECT DISTINCT s, u FROM v)),
    uc AS (SELECT s, u, a, p, count(*) AS n FROM v GROUP BY ALL),
    d AS (SELECT s, r.r AS rep, CAST('0x' || substr(md5('0|' || r.r || '|' || i), 1, 15) AS BIGINT) % k AS i FROM us, range({REPLICATES}) r(r)),
    c AS (SELECT s, -1 AS rep, a, p, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT s, -2, a, p, count(*) FROM v WHERE NOT near GROUP BY ALL
      UNION ALL SELECT d.s, rep, a, p, sum(n) FROM d JOIN us ON us.s = d.s AND us.i = d.i JOIN uc ON uc.s = us.s AND uc.u = us.u GROUP BY ALL),
    m AS (SELECT s, rep, sum(n)::DOUBLE AS n, sum(n * (a = p)::INT) / sum(n)::DOUBLE AS accuracy, sum(n * (abs(a - p) <= 1)::INT) / sum(n)::DOUBLE AS within_one_accuracy, sum(n * (a - p) * (a - p))::DOUBLE AS seen FROM c GROUP BY 1, 2),
    z AS (SELECT s, rep, z.z, sum(n * (a = z)::INT)::DOUBLE AS sup, sum(n * (p = z)::INT)::DOUBLE AS pre, sum(n * (a = z AND p = z)::INT)::DOUBLE AS tp FROM c, range({K}) z(z) GROUP BY ALL),
    b AS (SELECT s, rep, avg(tp / sup) FILTER (sup > 0) AS balanced_accuracy, avg(2 * tp / (sup + pre)) FILTER (sup + pre > 0) AS f1_macro,
      sum(sup * z * z) + sum(pre * z * z) - 2 * sum(sup * z) * sum(pre * z) / sum(sup) AS chance FROM z GROUP BY 1, 2),
    h AS (SELECT m.s, m.rep, n, accuracy, within_one_accuracy, balanced_accuracy, f1_macro, CASE WHEN chance > 1e-12 THEN 1 - seen / chance END AS quadratic_weighted_kappa FROM m JOIN b ON b.s = m.s AND b.rep = m.rep),
    q AS (SELECT s, {', '.join(f'quantile_cont({x}, 0.025) AS {x}_lo, quantile_cont({x}, 0.975) AS {x}_hi' for x in heads)} FROM h WHERE rep >= 0 GROUP BY 1),
    g AS (SELECT s, a.a, p.p FROM (SELECT DISTINCT s FROM r) s, range({K}) a(a), range({K}) p(p)),
    l AS (SELECT g.s, list(coalesce(c.n, 0)::BIGINT ORDER BY g.a, g.p) AS confusion FROM g LEFT JOIN c ON c.s = g.s AND c.rep = -1 AND c.a = g.a AND c.p = g.p GROUP BY 1),
    su AS (SELECT s.s, list(s.n ORDER BY s.a) AS support, list(s.nu ORDER BY s.a) AS support_units FROM
      (SELECT x.s, x.a, count(v.a) AS n, count(DISTINCT v.u) AS nu FROM (SELECT DISTINCT s, a FROM g) x LEFT JOIN v ON v.s = x.s AND v.a = x.a GROUP BY 1, 2) s GROUP BY 1),
    e AS (SELECT r.s, count(*) FILTER (p >= 0) AS n, count(DISTINCT u) FILTER (p >= 0) AS n_units, count(*) FILTER (p >= 0) / count(*)::DOUBLE AS coverage FROM r GROUP BY 1)
    SELECT {names}, e.n, n_units, {sql_r6('coverage')} AS coverage, confusion, support, support_units, CASE WHEN w.n > 0 AND w.n < e.n THEN w.n::BIGINT END AS n_clear,
      {', '.join(f"{sql_r6('f.' + x)} AS {x}, {sql_r6(f'CASE WHEN w.n > 0 AND w.n < e.n THEN w.{x} END')} AS {x}_clear, {sql_r6(x + '_lo')} AS {x}_lo, {sql_r6(x + '_hi')} AS {x}_hi" for x in heads)}
    FROM e JOIN l ON l.s = e.s JOIN su ON su.s = e.s LEFT JOIN h f ON f.s = e.s AND f.rep = -1 LEFT JOIN h w ON w.s = e.s AND w.rep = -2 LEFT JOIN q ON q.s = e.s"""


def _report(out: DataFrame) -> DataFrame:
    return rounded(out, "coverage", *[f"{h}{x}" for h in reports.HEADLINE for x in ("", "_clear", "_lo", "_hi")])


@query("class_report_by_priority", class_report_sql("SELECT o_orderpriority AS s, 'u' || (o_custkey % 37) AS u, a, p1 AS p, near FROM x", "e.s AS o_orderpriority"))
def class_report_by_priority(t: Tables) -> DataFrame:
    """Price classes of orders by priority, customers in 37 units resampled."""
    return _report(reports.class_report(classes(t), "a", "p1", K, unit="unit", by=["o_orderpriority"], near="near", replicates=REPLICATES))


SPLITS = {"key": "CASE WHEN o_orderkey % 3 = 0 THEN 'val' WHEN o_orderkey % 3 = 1 THEN 'test' ELSE 'train' END", "year": "CASE WHEN year(o_orderdate) >= 1997 THEN 'test' ELSE 'train' END"}
BASELINES = {"moved": "p1", "constant": "p2"}


@query(
    "baseline_class_reports",
    class_report_sql(
        " UNION ALL ".join(
            f"SELECT '{s}|' || part || '|{b}' AS s, 'u' || (o_custkey % 37) AS u, a, {p} AS p, near FROM (SELECT *, {case} AS part FROM x) WHERE part <> 'train'"
            for s, case in SPLITS.items() for b, p in BASELINES.items()
        ),
        "split_part(e.s, '|', 1) AS split, split_part(e.s, '|', 2) AS part, split_part(e.s, '|', 3) AS baseline",
    ),
)
def baseline_class_reports(t: Tables) -> DataFrame:
    """Two baselines under two splits, every part but train, in one pass."""
    rows = classes(t).withColumns({f"split_{s}": F.expr(case) for s, case in SPLITS.items()})
    out = reports.baseline_reports(
        rows, "a", K, unit="unit", splits={s: f"split_{s}" for s in SPLITS}, baselines={b: dict.fromkeys(SPLITS, p) for b, p in BASELINES.items()}, near="near", replicates=REPLICATES
    )
    return _report(out)


@query("rows_outside_classes", f"{SQL_CLASSES} SELECT o_orderpriority, count(*) FILTER (p1 < 0) AS n_out_of_range FROM x GROUP BY 1")
def rows_outside_classes(t: Tables) -> DataFrame:
    return classify.out_of_range(classes(t), "a", "p1", K, by=["o_orderpriority"])


ARMS = ["fused", "camera", "forecast"]
SQL_ARMS = """WITH r AS (SELECT o_orderpriority AS arrangement, o_orderstatus AS target, 'g' || (o_custkey % 23) AS grp, 'b' || (o_custkey % 61) AS buoy, o_orderkey AS sample_id,
      o_totalprice / 1e5 AS y, o_totalprice / 1e5 * (0.9 + (o_orderkey % 3) / 10.0::DOUBLE) AS fused, o_totalprice / 1e5 * (0.85 + (o_custkey % 4) / 10.0::DOUBLE) AS camera,
      CASE WHEN o_orderkey % 41 <> 0 THEN o_totalprice / 1e5 * 0.97 END AS forecast FROM orders)"""


def arms(t: Tables) -> DataFrame:
    y, k, c = F.col("o_totalprice") / 1e5, F.col("o_orderkey"), F.col("o_custkey")
    label = lambda p, n: F.concat(F.lit(p), (c % n).cast("string"))
    return t.orders.select(
        F.col("o_orderpriority").alias("arrangement"), F.col("o_orderstatus").alias("target"), label("g", 23).alias("grp"), label("b", 61).alias("buoy"), k.alias("sample_id"),
        y.alias("y"), (y * (0.9 + (k % 3) / 10.0)).alias("fused"), (y * (0.85 + (c % 4) / 10.0)).alias("camera"), F.when(k % 41 != 0, y * 0.97).alias("forecast"),
    )


def contrast_ctes(tag: str, source: str, stratum: str, unit: str, equal: bool) -> str:
    """CTEs ``o<tag>`` of ``s, control, rows, units, rmse_candidate, rmse_control, delta, delta_lo, delta_hi``."""
    each = "/ count(*)::DOUBLE" if equal else ""
    pairs = [(f"e{i}", a) for i, a in enumerate(ARMS)]
    return f"""u{tag} AS (SELECT {stratum} AS s, {unit} AS u, count(*) AS n, {'1.0' if equal else 'count(*)'}::DOUBLE AS w, {', '.join(f'sum(({a} - y) * ({a} - y)) {each} AS {e}' for e, a in pairs)}
      FROM {source} WHERE forecast IS NOT NULL GROUP BY 1, 2),
    i{tag} AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY s) AS k FROM u{tag}),
    d{tag} AS (SELECT s, r.r AS rep, CAST('0x' || substr(md5('0|' || r.r || '|' || i), 1, 15) AS BIGINT) % k AS i FROM i{tag}, range({REPLICATES}) r(r)),
    p{tag} AS (SELECT d.s, rep, {', '.join(f'sqrt(sum({e}) / sum(w)) AS {e}' for e, _ in pairs)} FROM d{tag} d JOIN i{tag} i ON i.s = d.s AND i.i = d.i GROUP BY 1, 2),
    w{tag} AS (SELECT s, sum(n)::BIGINT AS rows, count(*) AS units, {', '.join(f'sqrt(sum({e}) / sum(w)) AS {e}' for e, _ in pairs)} FROM u{tag} GROUP BY 1),
    o{tag} AS ({' UNION ALL '.join(f"SELECT w.s, '{a}' AS control, any_value(rows) AS rows, any_value(units) AS units, any_value(w.e0) AS rmse_candidate, any_value(w.{e}) AS rmse_control, any_value(w.e0 - w.{e}) AS delta, quantile_cont(p.e0 - p.{e}, 0.025) AS delta_lo, quantile_cont(p.e0 - p.{e}, 0.975) AS delta_hi FROM w{tag} w JOIN p{tag} p ON p.s = w.s GROUP BY 1" for e, a in pairs[1:])})"""


NUMBERS = ["rmse_candidate", "rmse_control", "delta", "delta_lo", "delta_hi"]
ENDS = ", ".join(f"{sql_r6(x)} AS {x}" for x in NUMBERS)
STRATUM = "arrangement || '|' || target"
WAYS = {"by_group": ("grp", False), "by_station": ("buoy", False), "equal_group": ("grp", True)}
SQL_ENDPOINTS = f"{SQL_ARMS}, " + ", ".join(contrast_ctes(w, "r", STRATUM, u, e) for w, (u, e) in WAYS.items())
SQL_ENDPOINTS += ", o AS (" + " UNION ALL ".join(f"SELECT *, '{w}' AS weighting FROM o{w}" for w in WAYS) + ")"


def _endpoints(t: Tables) -> DataFrame:
    return reports.endpoint_summary(arms(t), "y", "fused", ["camera", "forecast"], by=["arrangement", "target"], group="grp", station="buoy", replicates=REPLICATES)


@query(
    "endpoint_summary",
    f"{SQL_ENDPOINTS} SELECT split_part(s, '|', 1) AS arrangement, split_part(s, '|', 2) AS target, control, weighting, rows, units, {ENDS}, delta_hi < 0 AS met FROM o",
)
def endpoint_summary(t: Tables) -> DataFrame:
    """Two controls at every arrangement and target, weighted three ways."""
    return rounded(_endpoints(t), *NUMBERS)


@query(
    "bar_met",
    f"""{SQL_ENDPOINTS} SELECT split_part(s, '|', 1) AS arrangement, count(*) AS endpoints, bool_and(delta_hi < 0) AS bar_met FROM o
    WHERE weighting = 'by_group' AND control = 'camera' GROUP BY 1""",
)
def bar_met(t: Tables) -> DataFrame:
    return reports.bar_met(_endpoints(t), ["arrangement"], "camera")


@query(
    "registered_comparison",
    f"""{SQL_ARMS}, f AS (SELECT * FROM r WHERE forecast IS NOT NULL), {contrast_ctes('x', 'f', "'all'", 'grp', False)}
    SELECT (SELECT count(*) FROM f) AS strips, (SELECT count(DISTINCT buoy) FROM f) AS stations, (SELECT count(DISTINCT grp) FROM f) AS groups,
      {', '.join(f"{sql_r6(f'(SELECT 1 - sum(({a} - y) * ({a} - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)) FROM f)')} AS r2_{a}" for a in ARMS)},
      control AS primary_control, {sql_r6('delta')} AS delta, {sql_r6('delta_lo')} AS delta_lo, {sql_r6('delta_hi')} AS delta_hi, delta_hi < 0 AS primary_met FROM ox WHERE control = 'camera'""",
)
def registered_comparison(t: Tables) -> DataFrame:
    rows = arms(t).where("forecast is not null")
    out = reports.registered_comparison(rows, "sample_id", "y", ARMS, "fused", ["camera", "forecast"], group="grp", station="buoy", replicates=REPLICATES)
    return rounded(out, *[f"r2_{a}" for a in ARMS], "delta", "delta_lo", "delta_hi")


SCORES = ["bias", "mae", "rmse", "r2", "correlation", "accuracy", "within_one"]


@query(
    "arm_scorecard",
    f"""{SQL_ARMS}, l AS ({' UNION ALL '.join(f"SELECT target, '{a}' AS arm, y, {a} AS p FROM r" for a in ARMS)}),
    b AS (SELECT *, (p >= 0.5)::INT + (p >= 1.25)::INT + (p >= 2.5)::INT - (y >= 0.5)::INT - (y >= 1.25)::INT - (y >= 2.5)::INT AS step FROM l WHERE p IS NOT NULL)
    SELECT target, arm, count(*) AS n, {sql_r6('avg(p - y)')} AS bias, {sql_r6('avg(abs(p - y))')} AS mae, {sql_r6('sqrt(avg((p - y) * (p - y)))')} AS rmse,
      {sql_r6('1 - avg((p - y) * (p - y)) / var_pop(y)')} AS r2, {sql_r6('corr(y, p)')} AS correlation, {sql_r6('avg((step = 0)::INT)')} AS accuracy, {sql_r6('avg((abs(step) <= 1)::INT)')} AS within_one FROM b GROUP BY 1, 2""",
)
def arm_scorecard(t: Tables) -> DataFrame:
    return rounded(reports.arm_scorecard(arms(t), "y", ARMS, [0.5, 1.25, 2.5], by=["target"]), *SCORES)
