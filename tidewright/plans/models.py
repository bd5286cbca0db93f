"""Queries of local corrections, correctors with trees, wide ridge, user metrics and audits by random pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adapt, images, leakage, metrics, multi_ridge, user_metrics
from .registry import Tables, query, r6, rounded, sql_r6
from .scoring import REPLICATES, SQL_PRED, draws_sql, predictions

KS, LAMBDAS, N_DRAWS = [1, 3, 5], [0.0, 2.0, 10.0], 4
SQL_SHOTS = f"""WITH f AS (SELECT event_id, user_id AS site, user_id % 2 AS part, value AS y, ln(greatest(value * (0.6 + (user_id % 7) / 10.0::DOUBLE) + event_id % 3, 0.05)) AS lp,
      (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400e6 AS age FROM events),
    s AS (SELECT part, site, count(*) AS n, sum(exp(lp) * exp(lp)) AS pp, sum(exp(lp) * y) AS py, sum(y * y) AS yy FROM f WHERE age >= 8 GROUP BY 1, 2 HAVING count(*) >= 3),
    w AS (SELECT part, site, event_id, ln(greatest(y, 0.05)) - lp AS r FROM f WHERE age < 7),
    o AS (SELECT part, site, d.d AS draw, r, row_number() OVER (PARTITION BY part, site, d.d ORDER BY substr(md5('0|' || d.d || '|' || event_id), 1, 15), event_id) AS k FROM w, range({N_DRAWS}) d(d)),
    b AS (SELECT part, site, draw, k.k AS k, sum(r) AS r FROM o JOIN (SELECT unnest({KS}) AS k) k ON o.k <= k.k GROUP BY ALL HAVING count(*) = k.k),
    e AS (SELECT part, site, b.k, lam, avg(exp(r / (b.k + lam))) AS f1, avg(power(exp(r / (b.k + lam)), 2)) AS f2 FROM b, (SELECT unnest({LAMBDAS}::DOUBLE[]) AS lam) GROUP BY ALL),
    c AS (SELECT part, k, lam, count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS n_rows, sqrt(sum(f2 * pp - 2 * f1 * py + yy) / sum(n)) AS rmse, sqrt(sum(pp - 2 * py + yy) / sum(n)) AS rmse_before
      FROM e JOIN s USING (part, site) GROUP BY ALL)"""


def _shots(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("first"))
    e = t.events.join(first, "user_id")
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 86400e6
    p = F.ln(F.greatest(F.col("value") * (0.6 + (F.col("user_id") % 7) / 10.0) + F.col("event_id") % 3, F.lit(0.05)))
    return e.select("event_id", F.col("user_id").alias("site"), (F.col("user_id") % 2).alias("part"), F.col("value").alias("y"), p.alias("lp"), (age < 7).alias("early"), (age >= 8).alias("late"))


def _curve(t: Tables) -> DataFrame:
    return adapt.few_shot_curve(
        _shots(t), site="site", row_id="event_id", window="early", evaluate="late", observed="y", log_prediction="lp", ks=KS, shrinkage=LAMBDAS, n_draws=N_DRAWS, min_eval=3, by=["part"]
    )


@query("few_shot_curve", f"{SQL_SHOTS} SELECT part, CAST(k AS INT) AS k, lam, n_sites, n_rows, {sql_r6('rmse')} AS rmse, {sql_r6('rmse_before')} AS rmse_before FROM c")
def few_shot_curve(t: Tables) -> DataFrame:
    """A user's log bias from one to five rows of its first week, rated from the ninth day on."""
    return rounded(_curve(t), "rmse", "rmse_before")


@query(
    "few_shot_shrinkage",
    f"""{SQL_SHOTS}, m AS (SELECT part, lam, avg(rmse) AS m FROM c GROUP BY 1, 2) SELECT part, first(lam ORDER BY m, lam) AS lam, {sql_r6('min(m)')} AS mean_rmse FROM m GROUP BY 1""",
)
def few_shot_shrinkage(t: Tables) -> DataFrame:
    return rounded(adapt.best_shrinkage(_curve(t), ["part"]), "mean_rmse")


@query(
    "adapted_coverage",
    f"""WITH b AS (SELECT l_suppkey AS site, CAST(l_suppkey % 4 AS INT) AS fold, ln(greatest(l_extendedprice / 1e4, 0.05)) - ln(greatest(l_quantity / 20, 0.05)) AS r, 0.5 + l_tax AS sd FROM lineitem),
    m AS (SELECT site, avg(r) AS bias FROM b WHERE site % 3 <> 0 GROUP BY 1), s AS (SELECT site, fold, abs(r - coalesce(bias, 0)) / sd AS s FROM b LEFT JOIN m USING (site)),
    n AS (SELECT site, fold, count(*) AS n FROM s GROUP BY 1, 2), x AS (SELECT k.k AS fold, s.s, 1.0::DOUBLE / n.n AS w FROM range(4) k(k) JOIN s ON s.fold <> k.k JOIN n ON n.site = s.site),
    y AS (SELECT fold, s, sum(w) AS w FROM x GROUP BY 1, 2), z AS (SELECT fold, s, sum(w) OVER (PARTITION BY fold ORDER BY s) AS c FROM y),
    g AS (SELECT k.k AS fold, count(*) AS groups FROM range(4) k(k) JOIN n ON n.fold <> k.k GROUP BY 1),
    q AS (SELECT fold, min(s) FILTER (c / (groups + 1) >= 0.8 - 1e-12) AS q FROM z JOIN g USING (fold) GROUP BY 1)
    SELECT site, count(*) AS n, {sql_r6('avg(CASE WHEN s <= q THEN 1.0 ELSE 0 END)')} AS coverage FROM s JOIN q USING (fold) GROUP BY GROUPING SETS ((site), ())""",
)
def adapted_coverage(t: Tables) -> DataFrame:
    """Two of three suppliers have their centres moved by their mean residual; coverage by supplier and of all rows."""
    centre = F.ln(F.greatest(F.col("l_quantity") / 20, F.lit(0.05)))
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("site"), (F.col("l_suppkey") % 4).cast("int").alias("fold"), (F.col("l_extendedprice") / 1e4).alias("y"), centre.alias("mu"), (0.5 + F.col("l_tax")).alias("sd")
    )
    away = F.ln(F.greatest("y", F.lit(0.05))) - F.col("mu")
    biases = rows.where("site % 3 <> 0").groupBy("site").agg(F.avg(away).alias("bias"))
    out = adapt.adapted_coverage(rows, observed="y", centre="mu", sigma="sd", site="site", fold="fold", n_folds=4, biases=biases, level=0.8)
    return rounded(out, "coverage")


@query("forecast_corrector")
def forecast_corrector(t: Tables) -> DataFrame:
    """Prices by quantity, discount and tax, in two splits of the suppliers."""
    role = lambda k: F.when((F.col("l_suppkey") + k) % 5 == 0, "test").when((F.col("l_suppkey") + k) % 5 == 1, "val").otherwise("train")
    rows = t.lineitem.withColumns({"split_a": role(0), "split_b": role(2), "y": F.col("l_extendedprice") / 1e4})
    return adapt.forecast_corrector(
        rows, ["l_quantity", "l_discount", "l_tax"], "y", ["split_a", "split_b"], key=["l_orderkey", "l_linenumber"], group="l_suppkey", boost={"maxIter": 4, "maxDepth": 3}
    )


@query("multi_target_ridge")
def multi_target_ridge(t: Tables) -> DataFrame:
    """Three targets from the 64 numbers of each embedding, a model for each of two groups of vectors."""
    x = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select("vec_id", (F.col("vec_id") % 2).alias("part"), x.alias("x"), F.array(x[0] * 2 + x[5], x[1] * x[2], F.sin(x[3])).alias("y"))
    models = multi_ridge.fit(rows, "x", 64, "y", 3, by="part")
    out = multi_ridge.predict(rows, models, "x", by="part")
    return out.select("vec_id", F.transform("predictions", lambda p: r6(p)).alias("predictions"))


class PowerMean(user_metrics.Additive):
    """The mean of absolute errors to the power 1.5, taken back to their unit."""

    def __init__(self):
        super().__init__(lambda y, p: [len(y), (np.abs(p - y) ** 1.5).sum()], lambda s: (s[1] / s[0]) ** (2 / 3))


@query(
    "user_metric_bootstrap",
    f"""{SQL_PRED}, st AS (SELECT l_suppkey AS g, count(*) AS n, sum(power(abs(f - y), 1.5)) AS a FROM c GROUP BY 1) {draws_sql('sum(n) AS n, sum(a) AS a')}
    SELECT {sql_r6('(SELECT power(sum(a) / sum(n), 2 / 3::DOUBLE) FROM st)')} AS value, {sql_r6('quantile_cont(power(a / n, 2 / 3::DOUBLE), 0.025)')} AS value_lo,
      {sql_r6('quantile_cont(power(a / n, 2 / 3::DOUBLE), 0.975)')} AS value_hi FROM rp""",
)
def user_metric_bootstrap(t: Tables) -> DataFrame:
    out = user_metrics.cluster_bootstrap(predictions(t), "y", "f", "l_suppkey", PowerMean(), replicates=REPLICATES)
    return rounded(out, *out.columns)


@query(
    "user_metric_by_stratum",
    f"""{SQL_PRED} SELECT l_returnflag, l_linestatus, {sql_r6('power(avg(power(abs(f - y), 1.5)), 2 / 3::DOUBLE)')} AS value FROM c GROUP BY 1, 2""",
)
def user_metric_by_stratum(t: Tables) -> DataFrame:
    return rounded(user_metrics.by_stratum(predictions(t), "y", "f", ["l_returnflag", "l_linestatus"], PowerMean()), "value")


@query(
    "random_pair_distances",
    f"""WITH e AS (SELECT user_id % 5 AS cam, event_id, CAST(ts AS DATE) AS day, CAST('0x' || substr(md5(CAST(event_id % 700 AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY event_id) - 1 AS k FROM e), n AS (SELECT cam, count(*) AS n FROM e GROUP BY 1),
    d AS (SELECT cam, CAST('0x' || substr(md5('7|i|' || cam || '|' || x), 1, 15) AS BIGINT) % n AS i, CAST('0x' || substr(md5('7|j|' || cam || '|' || x), 1, 15) AS BIGINT) % n AS j FROM n, range(3000) r(x)),
    m AS (SELECT d.cam, bit_count(xor(a.h, b.h)) AS x FROM d JOIN p a ON a.cam = d.cam AND a.k = d.i JOIN p b ON b.cam = d.cam AND b.k = d.j WHERE a.day <> b.day)
    SELECT cam, count(*) AS pairs, {sql_r6('avg(CASE WHEN x <= 4 THEN 1.0 ELSE 0 END)')} AS near_share, {sql_r6('quantile_cont(x, 0.05)')} AS q05, {sql_r6('quantile_cont(x, 0.5)')} AS q50,
      {sql_r6('quantile_cont(x, 0.95)')} AS q95 FROM m GROUP BY 1""",
)
def random_pair_distances(t: Tables) -> DataFrame:
    h = F.conv(F.substring(F.md5((F.col("event_id") % 700).cast("string")), 1, 15), 16, 10).cast("bigint")
    rows = t.events.select((F.col("user_id") % 5).alias("cam"), "event_id", F.to_date("ts").alias("day"), h.alias("h"))
    out = leakage.random_pair_distances(rows, by="cam", day="day", hashes="h", order=["event_id"], pairs=3000, seed=7)
    return rounded(out, "near_share", "q05", "q50", "q95")


@query(
    "hourly_changes",
    f"""WITH e AS (SELECT user_id % 5 AS cam, epoch_us(ts) AS us, hour(ts) AS h, month(ts) AS mo, value AS v, sqrt(value + event_id % 50) AS y FROM events),
    l AS (SELECT *, lag(us) OVER w AS us0, lag(v) OVER w AS v0, lag(y) OVER w AS y0 FROM e WINDOW w AS (PARTITION BY cam ORDER BY us, v, y)),
    p AS (SELECT cam, h, mo, v - v0 AS dv, y - y0 AS dy FROM l WHERE (us - us0) / 3.6e9 > 0.75 AND (us - us0) / 3.6e9 < 1.25),
    r AS (SELECT cam, dv - quantile_cont(dv, 0.5) OVER (PARTITION BY cam, h, mo) AS x, dy FROM p),
    k AS (SELECT cam, rank() OVER (PARTITION BY cam ORDER BY x) + (count(*) OVER (PARTITION BY cam, x) - 1) / 2 AS a, rank() OVER (PARTITION BY cam ORDER BY dy) + (count(*) OVER (PARTITION BY cam, dy) - 1) / 2 AS b FROM r)
    SELECT cam, count(*) AS pairs, {sql_r6('corr(a, b)', 4)} AS rho FROM k GROUP BY 1""",
)
def hourly_changes(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 5).alias("cam"), F.col("ts").cast("timestamp").alias("ts"), "value", F.sqrt(F.col("value") + F.col("event_id") % 50).alias("y"))
    return rounded(images.hourly_changes(rows, by=["cam"], time="ts", value="value", height="y"), "rho", digits=4)


@query(
    "merge_seed_fields",
    f"""WITH s AS (SELECT o_orderkey, s, o_totalprice * (1 + s / 100.0::DOUBLE) AS hs, cos(o_custkey + s / 10.0::DOUBLE) AS c, sin(o_custkey + s / 10.0::DOUBLE) AS n,
      list_transform(range(0, 4), lambda i: CAST((o_custkey * (i + 2) + s) % 11 AS DOUBLE)) AS shape FROM orders, range(3) r(s) WHERE NOT (s = 2 AND o_orderkey % 10 = 0))
    SELECT o_orderkey, {sql_r6('exp(avg(ln(hs)))', 4)} AS hs, {sql_r6('degrees(atan2(avg(n), avg(c)))')} AS direction_deg, {sql_r6('sqrt(power(avg(c), 2) + power(avg(n), 2))')} AS agreement,
      {', '.join(f"{sql_r6(f'avg(shape[{k}])')} AS shape_{k}" for k in range(1, 5))} FROM s GROUP BY 1 HAVING count(*) = 3""",
)
def merge_seed_fields(t: Tables) -> DataFrame:
    """Three seeds of a height, a direction and a shape of four bins; orders that a seed leaves out are dropped."""
    seeds = t.orders.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("NOT (s = 2 AND o_orderkey % 10 = 0)")
    angle = F.col("o_custkey") + F.col("s") / 10.0
    shape = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("o_custkey") * (i + 2) + F.col("s")) % 11).cast("double"))
    rows = seeds.select("o_orderkey", (F.col("o_totalprice") * (1 + F.col("s") / 100.0)).alias("hs"), F.cos(angle).alias("c"), F.sin(angle).alias("n"), shape.alias("shape"))
    out = metrics.merge_seed_fields(rows, ["o_orderkey"], 3, points=["hs"], cos="c", sin="n", shapes={"shape": 4})
    bins = [r6(F.col("shape")[k]).alias(f"shape_{k + 1}") for k in range(4)]
    return out.select("o_orderkey", r6("hs", 4).alias("hs"), r6("direction_deg").alias("direction_deg"), r6("agreement").alias("agreement"), *bins)
