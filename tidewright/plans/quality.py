"""Queries of the quality tests: events are observations of a user and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import micros
from ..operators import align, qc
from .registry import Tables, query, r6, sql_r6

SERIES = ["user_id", "event_type"]
SQL_SERIES = """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, ts,
             CASE WHEN value > 200 THEN NULL ELSE value END AS v FROM events),
l AS (SELECT *, lag(us) OVER w AS pu, lag(v) OVER w AS pv, row_number() OVER w AS n FROM e
      WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id))"""


def observations(t: Tables) -> DataFrame:
    """Events with the largest values blanked, so that missing data are exercised."""
    v = F.when(F.col("value") > 200, None).otherwise(F.col("value"))
    return t.events.select("event_id", *SERIES, "ts", v.alias("v"))


@query(
    "qc_gap_and_rate",
    f"""{SQL_SERIES} SELECT event_id,
      CAST(CASE WHEN us - pu <= 0 THEN 4 WHEN us - pu > 86400e6 * 1.5 THEN 3 ELSE 1 END AS TINYINT) AS gap_flag,
      CAST(CASE WHEN v IS NULL THEN 9 WHEN abs(v - pv) > 60.0 * greatest((us - pu) / 1e6, 1.0) / 86400.0 THEN 4
           ELSE 1 END AS TINYINT) AS rate_flag FROM l""",
)
def qc_gap_and_rate(t: Tables) -> DataFrame:
    return qc.gap_and_rate(
        observations(t), by=SERIES, time="ts", value="v", tie="event_id", expected_s=86400.0,
        max_change=60.0, per_seconds=86400.0,
    ).select("event_id", "gap_flag", "rate_flag")


@query(
    "qc_flat_line",
    f"""{SQL_SERIES}, b AS (SELECT *, CASE WHEN abs(v - pv) <= 15 THEN 0 ELSE 1 END AS brk FROM l),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS island FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY us, event_id) AS run FROM i)
    SELECT event_id, CAST(CASE WHEN v IS NULL THEN 9 WHEN run >= 5 AND v <> 0 THEN 4 WHEN run >= 3 THEN 3 ELSE 1 END
      AS TINYINT) AS flat_flag FROM r""",
)
def qc_flat_line(t: Tables) -> DataFrame:
    return qc.flat_line(
        observations(t), by=SERIES, time="ts", value="v", tie="event_id", tolerance=15.0
    ).select("event_id", "flat_flag")


@query(
    "qc_mean_std",
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN value > 200 THEN NULL ELSE value END AS v FROM events),
    s AS (SELECT *, count(v) OVER w AS n, avg(v) OVER w AS mu, stddev_samp(v) OVER w AS sd FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 DAYS PRECEDING
                   AND INTERVAL 1 MICROSECOND PRECEDING))
    SELECT event_id, CAST(CASE WHEN v IS NULL THEN 9 WHEN n >= 6 AND abs(v - mu) > greatest(2 * sd, 1e-9 * greatest(abs(v), abs(mu))) THEN 3 ELSE 1 END
      AS TINYINT) AS mean_std_flag FROM s""",
)
def qc_mean_std(t: Tables) -> DataFrame:
    return qc.mean_std(
        observations(t), by=["user_id"], time="ts", value="v", window="10d", n_std=2.0
    ).select("event_id", "mean_std_flag")


@query(
    "qc_gross_range",
    """SELECT event_id, CAST(CASE WHEN value < 0.5 OR value > 250 THEN 4 WHEN value < 2 OR value > 120 THEN 3
       ELSE 1 END AS TINYINT) AS range_flag FROM events""",
)
def qc_gross_range(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", qc.gross_range("value", (0.5, 250.0), (2.0, 120.0)).alias("range_flag")
    )


@query(
    "qc_height_failure_propagates",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
        CASE WHEN l_quantity > 45 THEN 4 ELSE 1 END AS h,
        CASE WHEN l_tax = 0 THEN 9 WHEN l_tax > 0.06 THEN 3 ELSE 1 END AS o, l_extendedprice FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice,
      CAST(CASE WHEN h = 4 AND o <> 9 THEN 4 ELSE o END AS TINYINT) AS period_flag FROM f""",
)
def qc_height_failure_propagates(t: Tables) -> DataFrame:
    height = qc.gross_range("l_quantity", (0.0, 45.0))
    other = F.when(F.col("l_tax") == 0, qc.MISSING).when(F.col("l_tax") > 0.06, qc.SUSPECT).otherwise(qc.PASS)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        qc.propagate_height_failure(height, other).alias("period_flag"),
    )


@query(
    "qc_operational_frequency",
    """SELECT l_linenumber, CAST(CASE WHEN 0.05 * l_linenumber < 0.06 OR 0.05 * l_linenumber > 0.34 THEN 4
        WHEN 0.05 * l_linenumber < 0.11 OR 0.05 * l_linenumber > 0.29 THEN 3 ELSE 1 END AS TINYINT) AS bin_flag,
      count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def qc_operational_frequency(t: Tables) -> DataFrame:
    flag = qc.operational_frequency(0.05 * F.col("l_linenumber"), (0.06, 0.34), (0.11, 0.29))
    return t.lineitem.groupBy("l_linenumber", flag.alias("bin_flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "qc_steepness",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_discount > 0 THEN
        2 * pi() * l_quantity / 10 / (9.80665 * power(l_discount * 100 + 2, 2)) END AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CASE WHEN s IS NULL THEN 9 WHEN s > 0.142 THEN 4
      WHEN s > 0.07 THEN 3 ELSE 1 END AS TINYINT) AS steepness_flag FROM s""",
)
def qc_steepness(t: Tables) -> DataFrame:
    period = F.when(F.col("l_discount") > 0, F.col("l_discount") * 100 + 2)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        qc.steepness(F.col("l_quantity") / 10, period).alias("steepness_flag"),
    )


@query(
    "qc_spectral_consistency",
    """WITH c AS (SELECT o_orderkey, o_totalprice AS a, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) AS b
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
    SELECT o_orderkey, CAST(CASE WHEN a IS NULL OR b IS NULL THEN 2
      WHEN abs(a - b) > greatest(1000.0, 0.5 * abs(a)) THEN 3 ELSE 1 END AS TINYINT) AS consistency_flag FROM c""",
)
def qc_spectral_consistency(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(price).alias("b"))
    return t.orders.join(sums, "o_orderkey", "left").select(
        "o_orderkey", qc.spectral_consistency("o_totalprice", "b", 1000.0, 0.5).alias("consistency_flag")
    )


@query(
    "qc_directional_moments",
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice % 365 AS a1,
        l_quantity * 7 AS a2, l_discount * 10.5 AS r1, l_tax * 12 AS r2 FROM lineitem),
    c AS (SELECT *, r1 * cos(radians(a1)) AS x1, r1 * sin(radians(a1)) AS y1, r2 * cos(2 * radians(a2)) AS x2,
        r2 * sin(2 * radians(a2)) AS y2 FROM d)
    SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CASE
      WHEN r1 < 0 OR r1 > 1 OR r2 < 0 OR r2 > 1 OR a1 < 0 OR a1 > 360 OR a2 < 0 OR a2 > 360 THEN 4
      WHEN sqrt(power(x2 - (x1 * x1 - y1 * y1), 2) + power(y2 - 2 * x1 * y1, 2))
           - (1 - (x1 * x1 + y1 * y1)) > 1e-9 THEN 3 ELSE 1 END AS TINYINT) AS moment_flag FROM c""",
)
def qc_directional_moments(t: Tables) -> DataFrame:
    flag = qc.directional_moments(
        F.col("l_extendedprice") % 365, F.col("l_quantity") * 7, F.col("l_discount") * 10.5, F.col("l_tax") * 12
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", flag.alias("moment_flag"))


@query(
    "qc_provider_flag",
    """SELECT o_orderkey, CAST(CASE WHEN TRY_CAST(split_part(o_orderpriority, '-', 1) AS INT) IN (1, 2, 3, 4, 9)
       THEN TRY_CAST(split_part(o_orderpriority, '-', 1) AS INT) ELSE 2 END AS TINYINT) AS provider_flag FROM orders""",
)
def qc_provider_flag(t: Tables) -> DataFrame:
    text = F.regexp_replace("o_orderpriority", "-", "/")
    return t.orders.select("o_orderkey", qc.provider_flag(text).alias("provider_flag"))


@query(
    "qc_neighbour",
    """WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN value > 200 THEN NULL ELSE value END AS v,
        event_type FROM events),
    x AS (SELECT * FROM a WHERE event_type = 'click'), y AS (SELECT * FROM a WHERE event_type = 'view'),
    m AS (SELECT x.event_id, y.v, row_number() OVER (PARTITION BY x.event_id
            ORDER BY abs(x.us - y.us), y.us, y.event_id DESC) AS k
          FROM x JOIN y ON x.user_id = y.user_id AND abs(x.us - y.us) <= 86400000000)
    SELECT x.event_id, CAST(CASE WHEN x.v IS NULL THEN 9 WHEN m.v IS NULL THEN 2 WHEN abs(x.v - m.v) > 25 THEN 3
      ELSE 1 END AS TINYINT) AS neighbour_flag FROM x LEFT JOIN m ON x.event_id = m.event_id AND m.k = 1""",
)
def qc_neighbour(t: Tables) -> DataFrame:
    o = observations(t)
    other = o.where("event_type = 'view'").select("user_id", F.col("ts").alias("rts"), "event_id", F.col("v").alias("n"))
    paired = align.pair_nearest(
        o.where("event_type = 'click'"), other, tolerance="1d", by=["user_id"], target_time="ts",
        reference_time="rts", values=["n"], reference_tie="event_id",
    )
    return paired.select("event_id", qc.neighbour("v", "n_ref", 25.0).alias("neighbour_flag"))


def suite(t: Tables) -> DataFrame:
    """Gap, rate, flat-line and range tests of each series, and their combination."""
    f = qc.gap_and_rate(
        observations(t), by=SERIES, time="ts", value="v", tie="event_id", expected_s=86400.0, max_change=150.0
    )
    f = qc.flat_line(f, by=SERIES, time="ts", value="v", tie="event_id", tolerance=15.0)
    f = f.withColumn("range_flag", qc.gross_range("v", (0.1, 190.0), (1.0, 150.0)))
    return f.withColumn("qc_flag", qc.combine("gap_flag", "rate_flag", "flat_flag", "range_flag"))


SQL_SUITE = f"""{SQL_SERIES}, b AS (SELECT *, CASE WHEN abs(v - pv) <= 15 THEN 0 ELSE 1 END AS brk FROM l),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS island FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY us, event_id) AS run FROM i),
f AS (SELECT *, CASE WHEN us - pu <= 0 THEN 4 WHEN us - pu > 86400e6 * 1.5 THEN 3 ELSE 1 END AS gap_flag,
  CASE WHEN v IS NULL THEN 9 WHEN abs(v - pv) > 150 THEN 4 ELSE 1 END AS rate_flag,
  CASE WHEN v IS NULL THEN 9 WHEN run >= 5 AND v <> 0 THEN 4 WHEN run >= 3 THEN 3 ELSE 1 END AS flat_flag,
  CASE WHEN v IS NULL THEN 9 WHEN v < 0.1 OR v > 190 THEN 4 WHEN v < 1 OR v > 150 THEN 3 ELSE 1 END AS range_flag
  FROM r)"""
# All four tests share the ranks 1 < 3 < 4 < 9, so the strongest flag is the largest number.


@query(
    "qc_suite",
    f"""{SQL_SUITE} SELECT event_id, CAST(gap_flag AS TINYINT) AS gap_flag, CAST(rate_flag AS TINYINT) AS rate_flag,
      CAST(flat_flag AS TINYINT) AS flat_flag, CAST(range_flag AS TINYINT) AS range_flag,
      CAST(greatest(gap_flag, rate_flag, flat_flag, range_flag) AS TINYINT) AS qc_flag FROM f""",
)
def qc_suite(t: Tables) -> DataFrame:
    return suite(t).select("event_id", "gap_flag", "rate_flag", "flat_flag", "range_flag", "qc_flag")


@query(
    "qc_flag_counts",
    f"""{SQL_SUITE}, u AS (SELECT 'gap_flag' AS test, gap_flag AS g FROM f UNION ALL SELECT 'rate_flag', rate_flag FROM f
      UNION ALL SELECT 'flat_flag', flat_flag FROM f UNION ALL SELECT 'range_flag', range_flag FROM f)
    SELECT test, CASE g WHEN 1 THEN 'PASS' WHEN 2 THEN 'NOT_EVALUATED' WHEN 3 THEN 'SUSPECT' WHEN 4 THEN 'FAIL'
      ELSE 'MISSING' END AS flag_name, count(*) AS n FROM u GROUP BY 1, 2""",
)
def qc_flag_counts(t: Tables) -> DataFrame:
    return qc.flag_counts(suite(t), ["gap_flag", "rate_flag", "flat_flag", "range_flag"])


@query(
    "qc_worst_flag_by_user",
    f"""{SQL_SUITE} SELECT user_id, CAST(max(greatest(gap_flag, rate_flag, flat_flag, range_flag)) AS TINYINT) AS worst
    FROM f GROUP BY user_id""",
)
def qc_worst_flag_by_user(t: Tables) -> DataFrame:
    return suite(t).groupBy("user_id").agg(qc.worst("qc_flag").alias("worst"))


# The flagship: quality flags, window pairing, window-mean label, first exclusion reason.
@query(
    "labelled_samples",
    f"""{SQL_SUITE}, r1 AS (SELECT event_id AS ref_id, user_id, us, v,
        greatest(gap_flag, rate_flag, flat_flag, range_flag) AS q FROM f WHERE event_type = 'view'),
    t1 AS (SELECT event_id, user_id, us, greatest(gap_flag, rate_flag, flat_flag, range_flag) AS q
           FROM f WHERE event_type = 'click'),
    p AS (SELECT t1.event_id, r1.v FROM t1 JOIN r1 ON t1.user_id = r1.user_id
          AND abs(t1.us - r1.us) <= 43200000000 AND r1.q NOT IN (4, 9)),
    g AS (SELECT event_id, avg(v) AS label, max(v) - min(v) AS spread, count(*) AS n FROM p GROUP BY event_id)
    SELECT t1.event_id, t1.user_id, {sql_r6('g.label')} AS label,
      CASE WHEN g.n >= 2 THEN {sql_r6('g.spread')} END AS spread, coalesce(g.n, 0) AS n_records,
      CASE WHEN t1.q IN (4, 9) THEN 'target_quality' WHEN g.label IS NULL THEN 'no_reference'
           WHEN g.n >= 2 AND g.spread > 40 THEN 'label_spread' END AS excluded_by
    FROM t1 LEFT JOIN g ON t1.event_id = g.event_id""",
)
def labelled_samples(t: Tables) -> DataFrame:
    flagged = suite(t).select("event_id", "user_id", "event_type", "ts", "v", "qc_flag")
    targets = flagged.where("event_type = 'click'").select("event_id", "user_id", "ts", "qc_flag")
    half = F.expr("INTERVAL 10 MINUTES")
    records = flagged.where((F.col("event_type") == "view") & ~F.col("qc_flag").isin(qc.FAIL, qc.MISSING)).select(
        F.col("event_id").alias("ref_id"), "user_id", (F.col("ts") - half).alias("start_utc"),
        (F.col("ts") + half).alias("end_utc"), "v",
    )
    cand = align.pair_window(
        targets, records, window="12h", by=["user_id"], target_id="event_id", reference_id="ref_id",
        target_time="ts", values=["v"], rank=False,
    )
    labels = align.label_candidates(
        cand, "v", rule="window_mean", target="event_id", reference="ref_id", max_offset="12h"
    )
    out = targets.join(labels, "event_id", "left")
    reason = (
        F.when(F.col("qc_flag").isin(qc.FAIL, qc.MISSING), "target_quality")
        .when(F.col("label").isNull(), "no_reference")
        .when(F.col("spread") > 40, "label_spread")
    )
    return out.select(
        "event_id", "user_id", r6("label").alias("label"), r6("spread").alias("spread"),
        F.coalesce("n_records", F.lit(0).cast("bigint")).alias("n_records"), reason.alias("excluded_by"),
    )


@query(
    "validation_of_reported_height",
    f"""WITH r AS (SELECT user_id, date_trunc('day', ts) AS d, avg(value) FILTER (event_type = 'view') AS a,
        avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY 1, 2)
    SELECT user_id, count(*) AS n, {sql_r6('avg(a - b)')} AS mean_diff, {sql_r6('stddev_samp(a - b)')} AS sd_diff,
      {sql_r6('max(abs(a - b))')} AS max_abs_diff FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY user_id""",
)
def validation_of_reported_height(t: Tables) -> DataFrame:
    """Mean, deviation and largest difference of two measures of one record."""
    day = F.date_trunc("day", "ts")

    def side(kind: str, name: str) -> DataFrame:
        rows = t.events.where(F.col("event_type") == kind)
        return rows.groupBy("user_id", micros(day).alias("d")).agg(F.avg("value").alias(name))

    diff = F.col("a") - F.col("b")
    return (
        side("view", "a").join(side("click", "b"), ["user_id", "d"]).groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n"), r6(F.avg(diff)).alias("mean_diff"),
            r6(F.stddev_samp(diff)).alias("sd_diff"), r6(F.max(F.abs(diff))).alias("max_abs_diff"),
        )
    )
