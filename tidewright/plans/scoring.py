"""Queries of the evaluation operators: line prices are observed, list prices predict them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles, classes, stats
from ..operators import bootstrap, classify, conformal, metrics
from .registry import Tables, query, r6, rounded, sql_r6

SQL_PRED = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey, l_shipdate,
    l_extendedprice / 1e4 AS y, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity * p_retailprice / 1e4 END AS f,
    l_quantity * 7.2 AS dy, (l_quantity * 7.2 + l_discount * 400) % 360 AS df
  FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT * FROM p WHERE y IS NOT NULL AND f IS NOT NULL)"""


def predictions(t: Tables) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    j = t.lineitem.join(part, "l_partkey")
    f = F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity") * F.col("p_retailprice") / 1e4)
    dy = F.col("l_quantity") * 7.2
    return j.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_shipdate",
        (F.col("l_extendedprice") / 1e4).alias("y"), f.alias("f"), dy.alias("dy"),
        ((dy + F.col("l_discount") * 400) % 360).alias("df"),
    )


REG = {
    "bias": "avg(f - y)", "mae": "avg(abs(f - y))", "rmse": "sqrt(avg((f - y) * (f - y)))",
    "crmse": "stddev_pop(f - y)", "nrmse_mean": "sqrt(avg((f - y) * (f - y))) / avg(y)",
    "nrmse_range": "sqrt(avg((f - y) * (f - y))) / (max(y) - min(y))",
    "nrmse_std": "sqrt(avg((f - y) * (f - y))) / stddev_pop(y)", "scatter_index": "stddev_pop(f - y) / avg(y)",
    "r2": "1 - sum((f - y) * (f - y)) / (count(*) * var_pop(y))", "pearson": "corr(y, f)",
    "slope": "regr_slope(f, y)", "intercept": "regr_intercept(f, y)",
}


def reg(*names: str) -> str:
    return ", ".join(f"{sql_r6(REG[n])} AS {n}" for n in names or REG)


@query(
    "regression_report",
    f"""{SQL_PRED}, r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY y)
        + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2.0::DOUBLE AS ry,
        rank() OVER (PARTITION BY l_returnflag ORDER BY f) + (count(*) OVER (PARTITION BY l_returnflag, f) - 1) / 2.0::DOUBLE AS rf FROM c)
    SELECT l_returnflag, count(*) AS n, {reg()}, {sql_r6('corr(ry, rf)')} AS spearman FROM r GROUP BY 1""",
)
def regression_report(t: Tables) -> DataFrame:
    return rounded(metrics.regression_report(predictions(t), "y", "f", ["l_returnflag"]), *REG, "spearman")


@query("regression_report_overall", f"{SQL_PRED} SELECT count(*) AS n, {reg()} FROM c")
def regression_report_overall(t: Tables) -> DataFrame:
    return rounded(metrics.regression_report(predictions(t), "y", "f", rank=False), *REG)


@query(
    "nrmse_iqr",
    f"""{SQL_PRED} SELECT l_returnflag, {sql_r6('sqrt(avg((f - y) * (f - y))) / (quantile_cont(y, 0.75) - quantile_cont(y, 0.25))')}
      AS nrmse_iqr FROM c GROUP BY 1""",
)
def nrmse_iqr(t: Tables) -> DataFrame:
    return rounded(metrics.nrmse_iqr(predictions(t), "y", "f", ["l_returnflag"]), "nrmse_iqr")


@query(
    "metrics_by_stratum",
    f"""{SQL_PRED}, b AS (SELECT *, CASE WHEN y >= 0 AND y < 0.5 THEN '[0, 0.5)' WHEN y < 1.25 THEN '[0.5, 1.25)'
        WHEN y < 2.5 THEN '[1.25, 2.5)' WHEN y < 4 THEN '[2.5, 4)' WHEN y < 6 THEN '[4, 6)' ELSE '[6, inf)' END AS band FROM p)
    SELECT band, l_linestatus, count(*) AS n,
      CASE WHEN count(*) >= 1000 THEN {sql_r6('avg(f - y)')} END AS bias,
      CASE WHEN count(*) >= 1000 THEN {sql_r6('sqrt(avg((f - y) * (f - y)))')} END AS rmse FROM b GROUP BY 1, 2""",
)
def metrics_by_stratum(t: Tables) -> DataFrame:
    d = predictions(t).withColumn("band", classes.band_label("y"))
    out = metrics.metrics_by_stratum(d, "y", "f", ["band", "l_linestatus"], ["bias", "rmse"], min_n=1000)
    return rounded(out, "bias", "rmse")


@query(
    "scores_by_scope",
    f"""{SQL_PRED} SELECT l_returnflag, l_linestatus, count(*) AS n, {reg('rmse', 'mae', 'r2')} FROM c
      GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""",
)
def scores_by_scope(t: Tables) -> DataFrame:
    out = metrics.scores_by_scope(
        predictions(t), "y", "f", [[], ["l_returnflag"], ["l_linestatus"]], ["n", "rmse", "mae", "r2"]
    )
    return rounded(out, "rmse", "mae", "r2")


@query(
    "bland_altman",
    f"""{SQL_PRED} SELECT count(*) AS n, {sql_r6('avg(f - y)')} AS bias, {sql_r6('stddev_samp(f - y)')} AS sd,
      {sql_r6('avg(f - y) - 1.96 * stddev_samp(f - y)')} AS loa_lower, {sql_r6('avg(f - y) + 1.96 * stddev_samp(f - y)')} AS loa_upper,
      {sql_r6('regr_slope(f - y, y)')} AS proportional_slope FROM c""",
)
def bland_altman(t: Tables) -> DataFrame:
    out = metrics.bland_altman(predictions(t), "y", "f").drop("proportional_p")
    return rounded(out, "bias", "sd", "loa_lower", "loa_upper", "proportional_slope")


@query(
    "circular_report",
    f"""{SQL_PRED}, e AS (SELECT l_returnflag, dy, df, CASE WHEN w = -180 THEN 180 ELSE w END AS e FROM (SELECT *,
        (df - dy + 180) - 360 * floor((df - dy + 180) / 360) - 180 AS w FROM p) x),
    m AS (SELECT l_returnflag, count(*) AS n, degrees(atan2(sum(sin(radians(e))), sum(cos(radians(e))))) AS b,
        avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, atan2(sum(sin(radians(dy))), sum(cos(radians(dy)))) AS my,
        atan2(sum(sin(radians(df))), sum(cos(radians(df)))) AS mf FROM e GROUP BY 1)
    SELECT m.l_returnflag, any_value(n) AS n, {sql_r6('any_value(b)')} AS circ_bias_deg, {sql_r6('any_value(mae)')} AS circ_mae_deg,
      {sql_r6('any_value(rmse)')} AS circ_rmse_deg,
      {sql_r6('sum(sin(radians(dy) - my) * sin(radians(df) - mf)) / sqrt(sum(power(sin(radians(dy) - my), 2)) * sum(power(sin(radians(df) - mf), 2)))')} AS circ_corr
    FROM e JOIN m ON e.l_returnflag = m.l_returnflag GROUP BY 1""",
)
def circular_report(t: Tables) -> DataFrame:
    out = metrics.circular_report(predictions(t), "dy", "df", ["l_returnflag"])
    return rounded(out, "circ_bias_deg", "circ_mae_deg", "circ_rmse_deg", "circ_corr")


@query(
    "circular_mean_and_std",
    f"""SELECT l_shipdate, {sql_r6('CASE WHEN atan2(s, c) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END', 4)} AS mean_deg,
      {sql_r6('degrees(sqrt(-2 * ln(sqrt(s * s + c * c))))', 4)} AS std_deg FROM (SELECT l_shipdate, avg(sin(radians(l_quantity * 7))) AS s,
        avg(cos(radians(l_quantity * 7))) AS c FROM lineitem GROUP BY 1) WHERE sqrt(s * s + c * c) BETWEEN 1e-3 AND 0.999""",
)
def circular_mean_and_std(t: Tables) -> DataFrame:
    a = F.col("l_quantity") * 7
    g = t.lineitem.groupBy("l_shipdate").agg(
        r6(angles.circular_mean(a), 4).alias("mean_deg"), r6(angles.circular_std(a), 4).alias("std_deg"),
        angles.resultant_length(a).alias("r"),
    )
    return g.where("r between 1e-3 and 0.999").drop("r")


SQL_CLASSES = """
WITH c AS (SELECT d.lang, CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 1500 THEN 1 WHEN n_chars <= 4000 THEN 2 ELSE 3 END AS a,
    CASE WHEN length(text) - length(replace(text, ' ', '')) <= 90 THEN 0 WHEN length(text) - length(replace(text, ' ', '')) <= 250 THEN 1
         WHEN length(text) - length(replace(text, ' ', '')) <= 500 THEN 2 ELSE 3 END AS b FROM documents d)"""


def class_pairs(t: Tables) -> DataFrame:
    blanks = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    # The text is read once per row; the class refers to the count several times.
    d = t.documents.select("lang", "n_chars", blanks.alias("blanks"))
    return d.select(
        "lang", classes.right_closed_class("n_chars", (500, 1500, 4000)).alias("a"),
        classes.right_closed_class("blanks", (90, 250, 500)).alias("b"),
    )


@query(
    "confusion_matrix",
    f"""{SQL_CLASSES}, g AS (SELECT CAST(i AS INT) AS "true", CAST(j AS INT) AS pred FROM range(4) x(i), range(4) y(j)),
    n AS (SELECT a, b, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT "true", pred, coalesce(n, 0) AS n FROM g LEFT JOIN n ON a = "true" AND b = pred""",
)
def confusion_matrix(t: Tables) -> DataFrame:
    return classify.confusion_matrix(class_pairs(t), "a", "b", 4)


SQL_PER_CLASS = f"""{SQL_CLASSES}, k AS (SELECT lang, CAST(i AS INT) AS cls FROM (SELECT DISTINCT lang FROM c), range(4) x(i)),
s AS (SELECT k.lang, k.cls, count(*) FILTER (a = cls AND b = cls) AS tp, count(*) FILTER (a = cls) AS support,
    count(*) FILTER (b = cls) AS predicted FROM k JOIN c ON k.lang = c.lang GROUP BY 1, 2),
f AS (SELECT *, tp / nullif(predicted, 0)::DOUBLE AS p, tp / nullif(support, 0)::DOUBLE AS r,
    CASE WHEN tp > 0 THEN 2.0 * tp / (support + predicted) END AS f1 FROM s)"""


@query(
    "per_class_scores",
    f"""{SQL_PER_CLASS} SELECT lang, cls, {sql_r6('p')} AS precision, {sql_r6('r')} AS recall, {sql_r6('f1')} AS f1,
      support, predicted FROM f""",
)
def per_class_scores(t: Tables) -> DataFrame:
    out = classify.per_class(classify.confusion_matrix(class_pairs(t), "a", "b", 4, ["lang"]), ["lang"])
    return rounded(out, "precision", "recall", "f1")


@query(
    "classification_report",
    f"""{SQL_PER_CLASS}, m AS (SELECT lang, avg(r) AS ba,
        avg(coalesce(p, 0)) FILTER (support + predicted > 0) AS pm, avg(coalesce(r, 0)) FILTER (support + predicted > 0) AS rm,
        avg(coalesce(f1, 0)) FILTER (support + predicted > 0) AS fm, sum(coalesce(p, 0) * support) / sum(support) AS pw,
        sum(coalesce(r, 0) * support) / sum(support) AS rw, sum(coalesce(f1, 0) * support) / sum(support) AS fw FROM f GROUP BY 1),
    o AS (SELECT lang, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS acc, avg(abs(a - b)) AS om,
        avg(CASE WHEN abs(a - b) <= 1 THEN 1.0 ELSE 0 END) AS w1, sum((a - b) * (a - b)) AS seen FROM c GROUP BY 1),
    e AS (SELECT x.lang, sum((x.cls - y.cls) * (x.cls - y.cls) * x.support * y.predicted) AS ex FROM s x JOIN s y ON x.lang = y.lang GROUP BY 1)
    SELECT o.lang, o.n, {sql_r6('acc')} AS accuracy, {sql_r6('ba')} AS balanced_accuracy, {sql_r6('pm')} AS precision_macro,
      {sql_r6('rm')} AS recall_macro, {sql_r6('fm')} AS f1_macro, {sql_r6('pw')} AS precision_weighted, {sql_r6('rw')} AS recall_weighted,
      {sql_r6('fw')} AS f1_weighted, {sql_r6('om')} AS ordinal_mae, {sql_r6('w1')} AS within_one_accuracy,
      {sql_r6('1 - seen / (ex / o.n::DOUBLE)')} AS quadratic_weighted_kappa
    FROM o JOIN m ON o.lang = m.lang JOIN e ON o.lang = e.lang""",
)
def classification_report(t: Tables) -> DataFrame:
    out = classify.classification_report(class_pairs(t), "a", "b", 4, ["lang"])
    return rounded(out, *[c for c in out.columns if c not in ("lang", "n")])


@query(
    "class_table",
    """SELECT source, count(*) FILTER (n_chars <= 500) AS smooth, count(*) FILTER (n_chars > 500 AND n_chars <= 1500) AS slight,
      count(*) FILTER (n_chars > 1500 AND n_chars <= 4000) AS moderate, count(*) FILTER (n_chars > 4000) AS rough_or_more,
      count(*) AS total FROM documents GROUP BY 1""",
)
def class_table(t: Tables) -> DataFrame:
    d = t.documents.withColumn("c", classes.right_closed_class("n_chars", (500, 1500, 4000)))
    return classify.class_table(d, "c", classes.WMO_CLASSES, ["source"])


@query(
    "majority_class",
    """SELECT source, arg_min(c, (-n, c)) AS majority FROM (SELECT source, CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 1500 THEN 1
       WHEN n_chars <= 4000 THEN 2 ELSE 3 END AS c, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1""",
)
def majority_class(t: Tables) -> DataFrame:
    d = t.documents.withColumn("c", classes.right_closed_class("n_chars", (500, 1500, 4000)))
    return classify.majority_class(d, "c", ["source"])


@query(
    "inverse_frequency_weights",
    f"""WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT doc_id, labels.quality,
      {sql_r6('(SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n.n::DOUBLE)')} AS weight
    FROM labels JOIN n ON labels.quality = n.quality""",
)
def inverse_frequency_weights(t: Tables) -> DataFrame:
    return rounded(classify.inverse_frequency_weights(t.labels.select("doc_id", "quality"), "quality"), "weight")


@query(
    "assessable_classes",
    """SELECT event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) >= 2000 AND count(DISTINCT CAST(ts AS DATE)) >= 20 AS assessable
       FROM events GROUP BY 1""",
)
def assessable_classes(t: Tables) -> DataFrame:
    return classify.assessable(t.events.withColumn("d", F.to_date("ts")), "event_type", "d", 2000, 20)


@query(
    "class_bins",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 20000 OR o_totalprice >= 300000 THEN -1 WHEN o_totalprice < 80000 THEN 0
         WHEN o_totalprice < 150000 THEN 1 ELSE 2 END AS bin,
       abs(o_totalprice - 20000) <= 0.04 * 20000 OR abs(o_totalprice - 150000) <= 0.04 * 150000 AS near FROM orders""",
)
def class_bins(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", classes.left_closed_bin("o_totalprice", (20000, 80000, 150000, 300000)).alias("bin"),
        classes.near_boundary("o_totalprice", (20000, 150000)).alias("near"),
    )


REPLICATES = 200
SQL_DRAWS = """
, gi AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS k FROM st),
d AS (SELECT r.r AS replicate, CAST('0x' || substr(md5('{seed}|' || r.r || '|' || x.i), 1, 15) AS BIGINT) % x.k AS i
  FROM range({n}) r(r), gi x),
rp AS (SELECT d.replicate, {sums} FROM d JOIN gi ON d.i = gi.i JOIN st ON st.g = gi.g GROUP BY 1)"""


def draws_sql(sums: str, seed: int = 0) -> str:
    return SQL_DRAWS.format(sums=sums, seed=seed, n=REPLICATES)


@query(
    "cluster_bootstrap",
    f"""{SQL_PRED}, st AS (SELECT l_suppkey AS g, count(*) AS n, sum(f - y) AS se, sum((f - y) * (f - y)) AS see, sum(y) AS sy, sum(y * y) AS syy
        FROM c GROUP BY 1) {draws_sql('sum(n) AS n, sum(se) AS se, sum(see) AS see, sum(sy) AS sy, sum(syy) AS syy')}
    SELECT {sql_r6('(SELECT sqrt(sum(see) / sum(n)) FROM st)')} AS rmse, {sql_r6('(SELECT 1 - sum(see) / (sum(syy) - sum(sy) * sum(sy) / sum(n)) FROM st)')} AS r2,
      {sql_r6('quantile_cont(sqrt(see / n), 0.025)')} AS rmse_lo, {sql_r6('quantile_cont(sqrt(see / n), 0.975)')} AS rmse_hi,
      {sql_r6('quantile_cont(1 - see / (syy - sy * sy / n), 0.025)')} AS r2_lo, {sql_r6('quantile_cont(1 - see / (syy - sy * sy / n), 0.975)')} AS r2_hi FROM rp""",
)
def cluster_bootstrap(t: Tables) -> DataFrame:
    out = bootstrap.cluster_bootstrap(predictions(t), "y", "f", "l_suppkey", ["rmse", "r2"], replicates=REPLICATES)
    return rounded(out, *out.columns)


def second_arm(t: Tables) -> DataFrame:
    return predictions(t).withColumn("g2", F.col("f") * 0.98 + 0.02)


SQL_ARMS = f"""{SQL_PRED}, a AS (SELECT l_suppkey AS g, y, f, f * 0.98 + 0.02 AS q FROM c)"""


def _paired_sql(weight: str) -> str:
    return f"""{SQL_ARMS}, st AS (SELECT g, {weight.format(x='count(*)')} AS n, {weight.format(x='sum((f - y) * (f - y))')} AS a,
        {weight.format(x='sum((q - y) * (q - y))')} AS b FROM a GROUP BY 1) {draws_sql('sum(n) AS n, sum(a) AS a, sum(b) AS b')}
    SELECT {sql_r6('(SELECT sqrt(sum(a) / sum(n)) FROM st)')} AS rmse_a, {sql_r6('(SELECT sqrt(sum(b) / sum(n)) FROM st)')} AS rmse_b,
      {sql_r6('(SELECT sqrt(sum(a) / sum(n)) - sqrt(sum(b) / sum(n)) FROM st)')} AS delta,
      {sql_r6('quantile_cont(sqrt(a / n) - sqrt(b / n), 0.025)')} AS delta_lo, {sql_r6('quantile_cont(sqrt(a / n) - sqrt(b / n), 0.975)')} AS delta_hi FROM rp"""


@query("paired_bootstrap", _paired_sql("{x}"))
def paired_bootstrap(t: Tables) -> DataFrame:
    out = bootstrap.paired_bootstrap(second_arm(t), "y", "f", "g2", "l_suppkey", replicates=REPLICATES)
    return rounded(out, *out.columns)


@query("paired_bootstrap_equal_groups", _paired_sql("{x} / count(*)::DOUBLE"))
def paired_bootstrap_equal_groups(t: Tables) -> DataFrame:
    out = bootstrap.paired_bootstrap(
        second_arm(t), "y", "f", "g2", "l_suppkey", replicates=REPLICATES, equal_groups=True
    )
    return rounded(out, *out.columns)


@query(
    "moving_block_bootstrap",
    f"""WITH c AS (SELECT event_id, value AS y, value * 0.9 + 3 AS f, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events),
    b AS (SELECT r.r AS replicate, k.k, CAST('0x' || substr(md5('0|' || r.r || '|' || k.k), 1, 15) AS BIGINT) % (n - 24 + 1) AS s, n,
        CASE WHEN k.k = (n + 23) // 24 - 1 THEN n - ((n + 23) // 24 - 1) * 24 ELSE 24 END AS len
      FROM range(50) r(r), (SELECT any_value(n) AS n FROM c) z, range((SELECT (count(*) + 23) // 24 FROM events)) k(k)),
    rp AS (SELECT replicate, sum((f - y) * (f - y)) / any_value(b.n) AS m FROM b JOIN c ON c.i >= b.s AND c.i < b.s + b.len GROUP BY 1)
    SELECT {sql_r6('(SELECT sqrt(avg((f - y) * (f - y))) FROM c)')} AS rmse, {sql_r6('quantile_cont(sqrt(m), 0.025)')} AS rmse_lo,
      {sql_r6('quantile_cont(sqrt(m), 0.975)')} AS rmse_hi FROM rp""",
)
def moving_block_bootstrap(t: Tables) -> DataFrame:
    d = t.events.select("event_id", F.col("value").alias("y"), (F.col("value") * 0.9 + 3).alias("f"))
    out = bootstrap.moving_block_bootstrap(d, "y", "f", ["event_id"], ["rmse"], block=24, replicates=50)
    return rounded(out, *out.columns)


@query(
    "statistic_bootstrap",
    f"""WITH st AS (SELECT o_custkey AS g, sum(o_totalprice * o_totalprice) AS a, sum(o_totalprice) AS b FROM orders GROUP BY 1)
      {draws_sql('sum(a) AS a, sum(b) AS b', 4)}
    SELECT {sql_r6('(SELECT sum(a) / sum(b) FROM st)')} AS value, {sql_r6('quantile_cont(a / b, 0.025)')} AS value_lo,
      {sql_r6('quantile_cont(a / b, 0.975)')} AS value_hi FROM rp""",
)
def statistic_bootstrap(t: Tables) -> DataFrame:
    x = F.col("o_totalprice")
    out = bootstrap.custom_bootstrap(
        t.orders, "o_custkey", {"a": F.sum(x * x), "b": F.sum(x)}, F.col("a") / F.col("b"), replicates=REPLICATES, seed=4
    )
    return rounded(out, *out.columns)


SQL_SCORES = f"""{SQL_PRED}, s AS (SELECT l_suppkey AS g, CAST(l_suppkey % 4 AS INT) AS fold, l_returnflag, abs(f - y) AS e FROM c)"""


def scores(t: Tables) -> DataFrame:
    e = F.abs(F.col("f") - F.col("y"))
    fold = (F.col("l_suppkey") % 4).cast("int")
    return predictions(t).where("f is not null").select("l_suppkey", fold.alias("fold"), "l_returnflag", e.alias("e"))


@query(
    "conformal_threshold",
    f"""{SQL_SCORES}, w AS (SELECT e, 1.0::DOUBLE / (((SELECT count(DISTINCT g) FROM s) + 1) * count(*) OVER (PARTITION BY g)) AS w FROM s),
    m AS (SELECT e, sum(w) AS w FROM w GROUP BY e), r AS (SELECT e, sum(w) OVER (ORDER BY e) AS cum FROM m)
    SELECT {sql_r6('(SELECT min(e) FROM r WHERE cum >= 0.9 - 1e-12)')} AS threshold, (SELECT count(DISTINCT g) FROM s) AS n_groups""",
)
def conformal_threshold(t: Tables) -> DataFrame:
    return rounded(conformal.threshold(scores(t), "e", "l_suppkey", 0.9), "threshold")


SQL_OOF_T = f"""{SQL_SCORES}, x AS (SELECT k.k AS fold, s.g, s.e FROM s, range(4) k(k) WHERE s.fold <> k.k),
w AS (SELECT fold, e, 1.0::DOUBLE / ((kk.n + 1) * count(*) OVER (PARTITION BY x.fold, g)) AS w
      FROM x JOIN (SELECT fold AS f2, count(DISTINCT g) AS n FROM x GROUP BY 1) kk ON kk.f2 = x.fold),
m AS (SELECT fold, e, sum(w) AS w FROM w GROUP BY 1, 2), r AS (SELECT fold, e, sum(w) OVER (PARTITION BY fold ORDER BY e) AS cum FROM m),
th AS (SELECT fold, min(e) FILTER (cum >= 0.8 - 1e-12) AS t FROM r GROUP BY 1)"""


@query(
    "conformal_out_of_fold_coverage",
    f"""{SQL_OOF_T} SELECT l_returnflag, count(*) AS n, {sql_r6('avg(CASE WHEN e <= t THEN 1.0 ELSE 0 END)')} AS coverage
    FROM s JOIN th ON s.fold = th.fold GROUP BY 1""",
)
def conformal_out_of_fold_coverage(t: Tables) -> DataFrame:
    s = scores(t)
    th = conformal.out_of_fold_thresholds(s, "e", "l_suppkey", "fold", 4, 0.8)
    return rounded(conformal.coverage(s, "e", th, "fold", ["l_returnflag"]), "coverage")


@query(
    "interval_scores",
    f"""{SQL_PRED} SELECT l_returnflag, {sql_r6('avg(CASE WHEN y >= f - 0.1 AND y <= f + 0.5 THEN 1.0 ELSE 0 END)')} AS coverage,
      {sql_r6('avg((f + 0.5) - (f - 0.1))')} AS mean_width FROM c GROUP BY 1""",
)
def interval_scores(t: Tables) -> DataFrame:
    d = predictions(t).where("f is not null").withColumns({"lo": F.col("f") - 0.1, "hi": F.col("f") + 0.5})
    return rounded(metrics.interval_scores(d, "y", "lo", "hi", ["l_returnflag"]), "coverage", "mean_width")


@query(
    "calibration_curve",
    f"""{SQL_PRED}, l AS (SELECT * FROM (VALUES (0.5::DOUBLE, 0.6744897501960817), (0.8::DOUBLE, 1.2815515655446004),
        (0.9::DOUBLE, 1.6448536269514722), (0.95::DOUBLE, 1.959963984540054)) v(level, z))
    SELECT l_returnflag, level, {sql_r6('avg(CASE WHEN abs(y - f) / 0.4 <= z THEN 1.0 ELSE 0 END)')} AS coverage FROM c, l GROUP BY 1, 2""",
)
def calibration_curve(t: Tables) -> DataFrame:
    d = predictions(t).where("f is not null").withColumn("sigma", F.lit(0.4))
    return rounded(metrics.calibration_curve(d, "y", "f", "sigma", ["l_returnflag"]), "coverage")


def phi_sql(x: str) -> str:
    """The same normal distribution function in SQL."""

    def poly(cs):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * abs({x}) + {c!r}::DOUBLE)"
        return out

    tail = f"exp(-({x}) * ({x}) / 2) * {poly(stats.PHI_NUMERATOR)} / {poly(stats.PHI_DENOMINATOR)}"
    far = f"exp(-({x}) * ({x}) / 2) / (abs({x}) + 1 / (abs({x}) + 2 / (abs({x}) + 3 / (abs({x}) + 4 / (abs({x}) + 0.65))))) / 2.506628274631"
    up = f"(CASE WHEN abs({x}) > 37 THEN 0 WHEN abs({x}) < 7.07106781186547 THEN {tail} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {up} ELSE {up} END)"


@query(
    "gaussian_scores",
    f"""{SQL_PRED}, z AS (SELECT l_returnflag, (y - f) / 0.5 AS z FROM c)
    SELECT l_returnflag, {sql_r6('avg(z * z / 2 + ln(0.5) + ln(2 * pi()) / 2)')} AS nll,
      {sql_r6(f"avg(0.5 * (z * (2 * {phi_sql('z')} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))")} AS crps FROM z GROUP BY 1""",
)
def gaussian_scores(t: Tables) -> DataFrame:
    d = predictions(t).where("f is not null").withColumn("sigma", F.lit(0.5))
    return rounded(metrics.gaussian_scores(d, "y", "f", "sigma", ["l_returnflag"]), "nll", "crps")


@query(
    "lognormal_crps",
    f"""{SQL_PRED}, z AS (SELECT l_returnflag, y, ln(f) AS m, (ln(y) - ln(f)) / 0.3 AS w FROM c WHERE f > 0)
    SELECT l_returnflag, {sql_r6(f"avg(y * (2 * {phi_sql('w')} - 1) - 2 * exp(m + 0.045) * ({phi_sql('(w - 0.3)')} + {phi_sql('(0.3 / sqrt(2.0))')} - 1))")} AS crps
    FROM z GROUP BY 1""",
)
def lognormal_crps(t: Tables) -> DataFrame:
    crps = stats.lognormal_crps("y", F.ln("f"), F.lit(0.3))
    return predictions(t).where("f > 0").groupBy("l_returnflag").agg(r6(F.avg(crps)).alias("crps"))


@query(
    "merge_gaussians",
    f"""SELECT l_orderkey, {sql_r6('avg(l_quantity)')} AS mu,
      {sql_r6('sqrt(greatest(avg(l_tax * l_tax + l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 0))', 4)} AS sigma FROM lineitem GROUP BY 1""",
)
def merge_gaussians(t: Tables) -> DataFrame:
    out = metrics.merge_gaussians(t.lineitem, ["l_orderkey"], "l_quantity", "l_tax")
    return rounded(rounded(out, "mu"), "sigma", digits=4)


@query(
    "merge_seeds",
    f"""SELECT l_orderkey, {sql_r6('exp(avg(ln(l_extendedprice)))', 3)} AS point, {sql_r6('avg(ln(l_quantity))')} AS mu,
      {sql_r6('sqrt(greatest(avg(l_tax * l_tax + ln(l_quantity) * ln(l_quantity)) - avg(ln(l_quantity)) * avg(ln(l_quantity)), 0))', 4)} AS sigma
    FROM lineitem GROUP BY 1 HAVING count(*) = 4""",
)
def merge_seeds(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("m", F.ln("l_quantity"))
    out = metrics.merge_seeds(d, ["l_orderkey"], "l_extendedprice", "m", "l_tax", 4)
    return rounded(rounded(rounded(out, "point", digits=3), "mu"), "sigma", digits=4)


@query(
    "uneven_seeds",
    "SELECT l_orderkey, count(*) AS n_seeds FROM lineitem GROUP BY 1 HAVING count(*) <> 4",
)
def uneven_seeds(t: Tables) -> DataFrame:
    return metrics.uneven_seeds(t.lineitem, ["l_orderkey"], 4)


@query(
    "ensemble_class",
    f"""WITH m AS (SELECT l_orderkey, l_linenumber AS c, avg(l_extendedprice / 1e5) AS p FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, arg_min(c, (-p, c)) AS pred, {sql_r6('max(p)')} AS proba FROM m GROUP BY 1""",
)
def ensemble_class(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("p", F.col("l_extendedprice") / 1e5)
    return rounded(metrics.ensemble_class(d, ["l_orderkey"], "l_linenumber", "p"), "proba")


@query(
    "window_means",
    f"""SELECT user_id, {sql_r6('sqrt(avg(value * value))')} AS energy_mean, {sql_r6('exp(avg(ln(value)))')} AS geometric_mean FROM events GROUP BY 1""",
)
def window_means(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(
        r6(metrics.energy_mean("value")).alias("energy_mean"), r6(metrics.geometric_mean("value")).alias("geometric_mean")
    )


@query("event_scores")
def event_scores(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    side = t.events.select("user_id", us.alias("t"), "event_type")
    out = metrics.event_scores(
        side.where("event_type = 'click'"), side.where("event_type = 'view'"), ["user_id"], "t", 7200.0
    )
    return rounded(out, "interval_abs_error_sum_s", digits=3)
