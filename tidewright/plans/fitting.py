"""Queries of baselines, corrections and combiners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blends, fits
from .registry import Tables, query, r6, rounded, sql_r6
from .scoring import SQL_PRED, predictions

FEATURES = ["l_quantity", "l_discount", "l_tax"]
SQL_DATA = """
WITH d AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS q, l_discount AS u, l_tax AS x, l_extendedprice / 1e3 AS y,
    CAST(l_suppkey % 4 AS INT) AS fold, CASE l_orderkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS role,
    l_returnflag FROM lineitem)"""


def data(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") % 4
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", *FEATURES, (F.col("l_extendedprice") / 1e3).alias("y"),
        (F.col("l_suppkey") % 4).cast("int").alias("fold"),
        F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("role"), "l_returnflag",
    )


def ridge_sql(source: str, by: str, alpha: str) -> str:
    """Closed-form 2-feature ridge on standardised features (Cramer's rule)."""
    return f"""g AS (SELECT {by}, count(*)::DOUBLE AS n, avg(q) AS mq, avg(u) AS mu, stddev_pop(q) AS sq, stddev_pop(u) AS su, avg(y) AS my,
      covar_pop(q, u) AS cqu, covar_pop(q, y) AS cqy, covar_pop(u, y) AS cuy FROM {source} GROUP BY ALL),
    h AS (SELECT *, n + {alpha} AS d, n * cqu / (sq * su) AS o, n * cqy / sq AS ry, n * cuy / su AS ru FROM g),
    m AS (SELECT *, (ry * d - o * ru) / (d * d - o * o) AS bq, (d * ru - o * ry) / (d * d - o * o) AS bu FROM h)"""


@query(
    "ridge_by_group",
    f"""{SQL_DATA}, {ridge_sql("(SELECT * FROM d WHERE role = 'train')", 'l_returnflag', '5.0')}
    SELECT d.l_returnflag, count(*) AS n, {sql_r6('avg(my + bq * (q - mq) / sq + bu * (u - mu) / su)')} AS mean_pred,
      {sql_r6('sqrt(avg(power(my + bq * (q - mq) / sq + bu * (u - mu) / su - y, 2)))')} AS rmse
    FROM d JOIN m ON d.l_returnflag = m.l_returnflag WHERE role = 'test' GROUP BY 1""",
)
def ridge_by_group(t: Tables) -> DataFrame:
    d, by, f = data(t), ["l_returnflag"], FEATURES[:2]
    models = fits.ridge_fit(d.where("role = 'train'"), f, "y", by, alpha=5.0)
    p = fits.ridge_predict(d.where("role = 'test'"), models, f, by)
    return p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("prediction")).alias("mean_pred"),
        r6(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)))).alias("rmse"),
    )


@query(
    "ridge_out_of_fold",
    f"""{SQL_DATA}, x AS (SELECT k.k AS f2, q, u, y FROM d, range(4) k(k) WHERE d.fold <> k.k), {ridge_sql('x', 'f2', '1.0')}
    SELECT l_orderkey, l_linenumber, y, {sql_r6('my + bq * (q - mq) / sq + bu * (u - mu) / su')} AS prediction FROM d JOIN m ON d.fold = m.f2""",
)
def ridge_out_of_fold(t: Tables) -> DataFrame:
    out = fits.ridge_out_of_fold(data(t), FEATURES[:2], "y", "fold", alpha=1.0)
    return rounded(out.select("l_orderkey", "l_linenumber", "y", "prediction"), "prediction")


@query(
    "ridge_penalty_selection",
    f"""{SQL_DATA}, a AS (SELECT * FROM (VALUES (0.1::DOUBLE), (100.0::DOUBLE), (10000.0::DOUBLE)) v(alpha)),
    s AS (SELECT d.*, alpha FROM d, a), tr AS (SELECT * FROM s WHERE role = 'train'), {ridge_sql('tr', 'l_returnflag, alpha', 'alpha')},
    e AS (SELECT s.l_returnflag, s.alpha, sqrt(avg(power(my + bq * (q - mq) / sq + bu * (u - mu) / su - y, 2))) AS r
      FROM s JOIN m ON s.l_returnflag = m.l_returnflag AND s.alpha = m.alpha WHERE role = 'val' GROUP BY 1, 2)
    SELECT l_returnflag, arg_min(alpha, (r, alpha)) AS alpha, {sql_r6('min(r)', 5)} AS val_rmse FROM e GROUP BY 1""",
)
def ridge_penalty_selection(t: Tables) -> DataFrame:
    out = fits.ridge_select_alpha(
        data(t), FEATURES[:2], "y", role="role", alphas=[0.1, 100.0, 10000.0], by=["l_returnflag"]
    )
    return rounded(out.drop("model"), "val_rmse", digits=5)


@query(
    "climatology_baseline",
    f"""{SQL_DATA}, c AS (SELECT l_suppkey, l_linenumber, avg(y) AS m FROM d WHERE role = 'train' AND l_suppkey % 9 <> 0 GROUP BY 1, 2)
    SELECT d.l_orderkey, d.l_linenumber, d.y, {sql_r6("coalesce(c.m, (SELECT avg(y) FROM d WHERE role = 'train' AND l_suppkey % 9 <> 0))")} AS climatology
    FROM d LEFT JOIN c ON d.l_suppkey = c.l_suppkey AND d.l_linenumber = c.l_linenumber WHERE role = 'test'""",
)
def climatology_baseline(t: Tables) -> DataFrame:
    d = data(t)
    train = d.where("role = 'train' and l_suppkey % 9 <> 0")
    out = fits.climatology_predict(d.where("role = 'test'"), train, ["l_suppkey", "l_linenumber"], "y")
    return rounded(out.select("l_orderkey", "l_linenumber", "y", "climatology"), "climatology")


@query(
    "linear_correction_by_fold",
    f"""{SQL_DATA} SELECT fold, {sql_r6("regr_intercept(y, q) FILTER (role = 'train')")} AS a, {sql_r6("regr_slope(y, q) FILTER (role = 'train')")} AS b
    FROM d GROUP BY 1""",
)
def linear_correction_by_fold(t: Tables) -> DataFrame:
    out = fits.linear_correction(data(t), "l_quantity", "y", F.col("role") == "train", ["fold"])
    return rounded(out, "a", "b")


@query(
    "power_law_baseline",
    f"""{SQL_DATA} SELECT l_returnflag, {sql_r6('regr_intercept(ln(y), ln(q))')} AS a, {sql_r6('regr_slope(ln(y), ln(q))')} AS b
    FROM d WHERE role = 'train' GROUP BY 1""",
)
def power_law_baseline(t: Tables) -> DataFrame:
    out = fits.power_law(data(t), "l_quantity", "y", F.col("role") == "train", ["l_returnflag"])
    return rounded(out, "a", "b")


@query(
    "geometric_ratio_out_of_fold",
    f"""{SQL_DATA} SELECT k.k AS fold, {sql_r6('exp(avg(ln(y / q)))')} AS ratio FROM d, range(4) k(k) WHERE d.fold <> k.k GROUP BY 1""",
)
def geometric_ratio_out_of_fold(t: Tables) -> DataFrame:
    return rounded(fits.geometric_ratio_out_of_fold(data(t), "l_quantity", "y", "fold"), "ratio")


@query("logistic_combiner")
def logistic_combiner(t: Tables) -> DataFrame:
    """Quality of every document from its length and blanks, fitted on the labelled ones by inverse class frequency."""
    from ..operators.classify import inverse_frequency_weights

    blanks = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    d = t.documents.select("doc_id", F.log1p("n_chars").alias("a"), F.log1p(blanks).alias("b"))
    labelled = d.join(t.labels.select("doc_id", "quality"), "doc_id")
    model = fits.fit_logistic(inverse_frequency_weights(labelled, "quality"), ["a", "b"], "quality", "weight")
    out = fits.predict_logistic(model, d, ["a", "b"])
    return out.select("doc_id", "prediction", F.round(F.col("probability")[1], 3).alias("p_quality"))


@query(
    "site_alignment",
    f"""WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
    m AS (SELECT label, d, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY 1, 2)
    SELECT vec_id, CAST(l.d AS BIGINT) AS d, {sql_r6('(v - m) / CASE WHEN s > 0 THEN s ELSE 1 END')} AS aligned FROM l
    JOIN m ON l.label = m.label AND l.d = m.d""",
)
def site_alignment(t: Tables) -> DataFrame:
    out = fits.site_alignment(t.embeddings, "embedding", "label")
    return out.select("vec_id", F.posexplode_outer("aligned").alias("d", "aligned")).select(
        "vec_id", F.col("d").cast("bigint").alias("d"), r6("aligned").alias("aligned")
    )


# Forecast, camera and observed heights of one line; folds are suppliers mod 4.
SQL_BLEND = f"""{SQL_PRED}, b AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_suppkey % 4 AS INT) AS fold, y AS obs, f AS fc,
    y * 0.8 + dy / 400 AS cam, f * 1.1 AS total, y * 0.8 + dy / 400 - f AS dis FROM c)"""


def blend_rows(t: Tables) -> DataFrame:
    cam = F.col("y") * 0.8 + F.col("dy") / 400
    return predictions(t).where("f is not null").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", (F.col("l_suppkey") % 4).cast("int").alias("fold"),
        F.col("y").alias("obs"), F.col("f").alias("fc"), cam.alias("cam"), (F.col("f") * 1.1).alias("total"),
        (cam - F.col("f")).alias("dis"),
    )


@query(
    "variance_weight_blend",
    f"""{SQL_BLEND}, q AS (SELECT fold, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.5) AS q2, quantile_cont(total, 0.75) AS q3 FROM b GROUP BY 1),
    r AS (SELECT b.*, (total > q1)::INT + (total > q2)::INT + (total > q3)::INT AS bin, power(cam * cam - obs * obs, 2) AS rc,
        power(fc * fc - obs * obs, 2) AS rm FROM b JOIN q ON b.fold = q.fold),
    v AS (SELECT fold, bin, avg(rc) AS vc, avg(rm) AS vm FROM r GROUP BY 1, 2)
    SELECT r.fold, r.bin, count(*) AS n, {sql_r6('avg(sqrt((cam * cam / vc + fc * fc / vm) / (1 / vc + 1 / vm)))')} AS mean_blend,
      {sql_r6('avg(sqrt(greatest(total * total - fc * fc, 0) + (cam * cam / vc + fc * fc / vm) / (1 / vc + 1 / vm)))')} AS mean_total
    FROM r JOIN v ON r.fold = v.fold AND r.bin = v.bin GROUP BY 1, 2""",
)
def variance_weight_blend(t: Tables) -> DataFrame:
    b = blend_rows(t)
    w = blends.variance_weights(b, ["fold"], "obs", "fc", "cam", "total")
    out = blends.apply_variance_weights(b.drop("l_shipdate"), w, ["fold"], "fc", "cam", "total")
    cuts = w.where("bin = 0").select("fold", *blends.QUARTILES)
    out = out.join(F.broadcast(cuts), "fold").withColumn("bin", blends.cut_index("total", list(blends.QUARTILES)))
    return out.groupBy("fold", "bin").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("blend")).alias("mean_blend"), r6(F.avg("blend_total")).alias("mean_total")
    )


SQL_REL = f"""{SQL_BLEND}, q AS (SELECT fold, quantile_cont(fc, 1 / 3.0::DOUBLE) AS f1, quantile_cont(fc, 2 / 3.0::DOUBLE) AS f2,
    quantile_cont(dis, 1 / 3.0::DOUBLE) AS d1, quantile_cont(dis, 2 / 3.0::DOUBLE) AS d2 FROM b GROUP BY 1),
r AS (SELECT b.*, ((fc >= f1)::INT + (fc >= f2)::INT) * 3 + (dis >= d1)::INT + (dis >= d2)::INT AS cell FROM b JOIN q ON b.fold = q.fold),
w AS (SELECT fold, count(*) AS n, sum(dis * (obs - fc)) AS x, sum(dis * dis) AS s FROM r GROUP BY 1),
k AS (SELECT fold, s / n AS d2, least(greatest(x / s, 0), 1) AS c FROM w),
cl AS (SELECT r.fold, cell, count(*) AS n, sum(dis * (obs - fc)) AS x, sum(dis * dis) AS s FROM r GROUP BY 1, 2),
wt AS (SELECT k.fold, CAST(z.z AS INT) AS cell, coalesce(cl.n, 0) AS n, k.c,
    least(greatest((coalesce(cl.x, 0) + 100 * d2 * c) / (coalesce(cl.s, 0) + 100 * d2), 0), 1) AS weight
  FROM k CROSS JOIN range(9) z(z) LEFT JOIN cl ON cl.fold = k.fold AND cl.cell = z.z)"""


@query(
    "reliability_weights",
    f"{SQL_REL} SELECT fold, cell, {sql_r6('weight')} AS weight, {sql_r6('c')} AS constant, n AS rows FROM wt",
)
def reliability_weights(t: Tables) -> DataFrame:
    w = blends.reliability_weights(blend_rows(t), ["fold"], "obs", "fc", "dis", ["fc", "dis"])
    return rounded(w.select("fold", "cell", "weight", "constant", "rows"), "weight", "constant")


@query(
    "reliability_blend",
    f"""{SQL_REL} SELECT l_orderkey, l_linenumber, obs, {sql_r6('fc + weight * dis')} AS reliability, {sql_r6('fc + c * dis')} AS constant_blend
    FROM r JOIN wt ON r.fold = wt.fold AND r.cell = wt.cell""",
)
def reliability_blend(t: Tables) -> DataFrame:
    b = blend_rows(t)
    w = blends.reliability_weights(b, ["fold"], "obs", "fc", "dis", ["fc", "dis"])
    out = blends.apply_reliability(b, w, ["fold"], "fc", "dis", ["fc", "dis"])
    return rounded(out.select("l_orderkey", "l_linenumber", "obs", "reliability", "constant_blend"), "reliability", "constant_blend")


@query(
    "local_calibration",
    f"""{SQL_PRED}, b AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, y AS obs, f AS fc, y * 0.8 + dy / 400 - f AS dis FROM c),
    s AS (SELECT *, min(l_shipdate) OVER (PARTITION BY l_suppkey) AS t0, (SELECT avg(dis * dis) FROM b) AS m FROM b),
    o AS (SELECT l_suppkey, sum(dis * (obs - (fc + 0.5 * dis))) / (sum(dis * dis) + 50 * any_value(m)) AS offs FROM s
      WHERE l_shipdate < t0 + INTERVAL 7 DAYS GROUP BY 1 HAVING count(*) >= 2)
    SELECT l_orderkey, l_linenumber, obs, {sql_r6('fc + least(greatest(0.5 + offs, 0), 1) * dis')} AS local_blend
    FROM s JOIN o ON s.l_suppkey = o.l_suppkey WHERE l_shipdate >= t0 + INTERVAL 9 DAYS""",
)
def local_calibration(t: Tables) -> DataFrame:
    b = blend_rows(t).withColumn("w", F.lit(0.5))
    m = b.agg(F.avg(F.col("dis") * F.col("dis")).alias("m")).withColumn("_1", F.lit(1))
    b = b.withColumn("_1", F.lit(1)).join(F.broadcast(m), "_1").drop("_1")  # one row
    out = blends.local_calibration(
        b, station="l_suppkey", time="l_shipdate", observed="obs", forecast="fc", disagreement="dis", weight="w",
        mean_d2="m", min_rows=2,
    )
    return rounded(out.select("l_orderkey", "l_linenumber", "obs", "local_blend"), "local_blend")


@query(
    "calibration_coverage",
    """WITH s AS (SELECT l_suppkey, l_shipdate, min(l_shipdate) OVER (PARTITION BY l_suppkey) AS t0 FROM lineitem)
    SELECT l_suppkey, count(*) FILTER (l_shipdate < t0 + INTERVAL 7 DAYS) AS n_early, count(*) FILTER (l_shipdate >= t0 + INTERVAL 9 DAYS) AS n_later,
      count(*) FILTER (l_shipdate < t0 + INTERVAL 7 DAYS) >= 2 AS calibrated FROM s GROUP BY 1""",
)
def calibration_coverage(t: Tables) -> DataFrame:
    return blends.calibration_coverage(t.lineitem, station="l_suppkey", time="l_shipdate", min_rows=2)


@query(
    "gated_swap",
    f"""{SQL_BLEND}, g AS (SELECT *, 1 / (1 + exp(-(0.2 * fold - 0.3 * fc + 0.1 * dis))) AS w FROM b)
    SELECT l_orderkey, l_linenumber, obs, {sql_r6('w')} AS gate, {sql_r6('sqrt(w * cam * cam + (1 - w) * fc * fc)')} AS swap,
      {sql_r6('sqrt(greatest(total * total - fc * fc, 0) + w * cam * cam + (1 - w) * fc * fc)')} AS swap_total FROM g""",
)
def gated_swap(t: Tables) -> DataFrame:
    b = blend_rows(t)
    coef = b.select("fold").distinct().select(
        "fold", (0.2 * F.col("fold")).alias("b0"), F.lit(-0.3).alias("b1"), F.lit(0.1).alias("b2")
    )
    out = blends.gated_swap(b, coef, ["fold"], ["fc", "dis"], total="total", forecast="fc", camera="cam")
    return rounded(out.select("l_orderkey", "l_linenumber", "obs", "gate", "swap", "swap_total"), "gate", "swap", "swap_total")
