"""Queries of data packages, protocols, closed windows, residual and band corrections, weights carried to held-out folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corrections, packages
from .datasets import SQL_ALONG, along
from .fitting import FEATURES, SQL_DATA, data, ridge_sql
from .registry import Tables, query, rounded, sql_r6


@query(
    "week_split",
    """WITH w AS (SELECT DISTINCT strftime(o_orderdate, '%G-W%V') AS week FROM orders WHERE year(o_orderdate) = 1998),
    r AS (SELECT week, row_number() OVER (ORDER BY CAST('0x' || substr(md5('5|' || week), 1, 15) AS BIGINT), week) AS k, count(*) OVER () AS n FROM w)
    SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1998 THEN CASE WHEN k <= round_even(0.25 * n, 0) THEN 'val' ELSE 'train' END
      WHEN year(o_orderdate) = 1999 AND dayofyear(o_orderdate) > 10 THEN 'test' WHEN year(o_orderdate) = 2000 THEN 'later' ELSE '' END AS split
    FROM orders LEFT JOIN r ON strftime(o_orderdate, '%G-W%V') = week""",
)
def week_split(t: Tables) -> DataFrame:
    """Whole ISO weeks of 1998 to train and val, 1999 from its eleventh day on to test, 2000 to later."""
    rows = packages.add_calendar(t.orders, "o_orderdate", "UTC")
    return packages.week_split(rows, day="local_day", week="local_week", train_year=1998, test_year=1999, later_year=2000, val_share=0.25, embargo_days=10, seed=5).select("o_orderkey", "split")


BOUNDS, NAMES = [5.0, 20.0, 60.0], ["calm", "slight", "rough", "high"]
SQL_SAMPLES = f"""raw AS (SELECT event_id, ts, event_type, user_id % 40 AS station_id, CASE WHEN event_id % 37 <> 0 THEN value END AS label FROM events),
    kept AS (SELECT * FROM raw WHERE event_type <> 'error' AND label IS NOT NULL),
    heads AS (SELECT station_id // 4 AS c, 'g' || min(CAST(station_id AS VARCHAR)) AS station_group FROM kept GROUP BY 1),
    s AS (SELECT k.*, station_group, {' + '.join(f'(label > {b})::INT' for b in BOUNDS)} AS cls, {' OR '.join(f'abs(label - {b}) <= {0.04 * b}' for b in BOUNDS)} AS near,
      CASE WHEN ts >= TIMESTAMP '{{test}}' THEN 'test' WHEN ts >= TIMESTAMP '{{val}}' THEN 'val' ELSE 'train' END AS block,
      (ts >= TIMESTAMP '{{val}}' AND ts < TIMESTAMP '{{val}}' + INTERVAL 6 HOURS) OR (ts >= TIMESTAMP '{{test}}' AND ts < TIMESTAMP '{{test}}' + INTERVAL 6 HOURS) AS held FROM kept k JOIN heads ON c = station_id // 4)"""
VAL_START, TEST_START = "2024-01-12", "2024-01-20"
SAMPLES = SQL_SAMPLES.format(val=VAL_START, test=TEST_START)


def _package_sql(select: str) -> str:
    group = SQL_ALONG.format(key="station_group", source="s", seed=1, label="CASE WHEN x < 0.6 THEN 'train' WHEN x < 0.6 + 0.2 THEN 'val' ELSE 'test' END")
    return f"WITH {SAMPLES}, {group.strip().removeprefix('WITH ')}, p AS (SELECT s.*, w.label AS split_station, CASE WHEN held THEN 'excluded' ELSE block END AS split_time FROM s JOIN w ON w.g = s.station_group) {select}"


def _package(t: Tables) -> packages.Package:
    """Events as samples of forty stations, four to a chain of half a degree each."""
    s = F.col("user_id") % 40
    samples = t.events.select(
        "event_id", "ts", "event_type", s.alias("station_id"), F.when(F.col("event_id") % 37 != 0, F.col("value")).alias("label"),
        (F.floor(s / 4) * 10 - 50.0).alias("latitude"), ((s % 4) * 0.5).alias("longitude"),
    )
    return packages.assemble(
        samples, id_col="event_id", label="label", time="ts", filters=[{"column": "event_type", "op": "ne", "value": "error"}], bounds=BOUNDS, names=NAMES,
        protocols={
            "station": {"protocol": "iid_grouped", "group_cols": "station_group", "fractions": (0.6, 0.2, 0.2), "seed": 1},
            "time": {"protocol": "cross_time", "time_col": "ts", "val_start": VAL_START, "test_start": TEST_START, "embargo": "6h"},
        },
        audits={"station": {"groups": ["station_id", "station_group"]}, "time": {"time": "ts", "by": ["station_id"], "min_gap": "9d"}},
        station="station_id", group_km=100,
    )


@query("package_samples", _package_sql(f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS local_day, cls AS class, {NAMES}[cls + 1] AS class_name, near AS near_boundary, station_group, split_station, split_time FROM p"))
def package_samples(t: Tables) -> DataFrame:
    return _package(t).samples.select("event_id", "local_day", "class", "class_name", "near_boundary", "station_group", "split_station", "split_time")


@query("package_exclusions", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'event_type ne ''error''' ELSE 'label notna None' END AS excluded_by FROM events WHERE event_type = 'error' OR event_id % 37 = 0 OR value IS NULL")
def package_exclusions(t: Tables) -> DataFrame:
    return _package(t).exclusions


@query(
    "package_audits",
    _package_sql(
        """SELECT 'station' AS split, n AS shared_groups, 0 AS temporal_neighbours, n = 0 AS ok FROM (SELECT
        (SELECT count(*) FROM (SELECT station_id FROM p GROUP BY 1 HAVING bool_or(split_station = 'test') AND bool_or(split_station IN ('train', 'val'))))
        + (SELECT count(*) FROM (SELECT station_group FROM p GROUP BY 1 HAVING bool_or(split_station = 'test') AND bool_or(split_station IN ('train', 'val')))) AS n)
        UNION ALL SELECT 'time', 0, n, n = 0 FROM (SELECT count(*) AS n FROM p a WHERE split_time = 'test' AND ts < (SELECT max(ts) FROM p b WHERE b.station_id = a.station_id AND b.split_time = 'train') + INTERVAL 9 DAYS)"""
    ),
)
def package_audits(t: Tables) -> DataFrame:
    return _package(t).audits.select("split", "shared_groups", "temporal_neighbours", "ok")


@query("package_stations", _package_sql("SELECT CAST(station_id AS VARCHAR) AS station_id, count(*) AS samples, any_value(station_group) AS station_group FROM p GROUP BY 1"))
def package_stations(t: Tables) -> DataFrame:
    return _package(t).stations.select("station_id", "samples", "station_group")


SPECS = {
    "group": {"protocol": "iid_grouped", "group_cols": "o_custkey"},
    "time": {"protocol": "cross_time", "time_col": "o_orderdate", "val_start": "1999-01-01", "test_start": "2000-06-01", "embargo": "30d"},
    "status": {"protocol": "cross_station", "group_col": "o_orderstatus", "test_groups": ["P"], "val_groups": ["O"]},
    "extreme": {"protocol": "extreme", "value_col": "o_totalprice", "quantile": 0.9, "id_col": "o_orderkey"},
}


@query(
    "protocol_labels",
    along("o_custkey", "orders", 0.7, 0.15, 0.15)
    + """SELECT o_orderkey, label AS split_group, CASE WHEN (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '1999-01-31') OR (o_orderdate >= TIMESTAMP '2000-06-01' AND o_orderdate < TIMESTAMP '2000-07-01') THEN 'excluded'
      WHEN o_orderdate >= TIMESTAMP '2000-06-01' THEN 'test' WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'val' ELSE 'train' END AS split_time,
      CASE o_orderstatus WHEN 'P' THEN 'test' WHEN 'O' THEN 'val' ELSE 'train' END AS split_status,
      CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.9) FROM orders) THEN 'test' WHEN CAST('0x' || substr(md5('0|' || o_orderkey), 1, 15) AS BIGINT) % 1000000 / 1e6 < 0.15 THEN 'val' ELSE 'train' END AS split_extreme
    FROM orders JOIN w ON CAST(o_custkey AS VARCHAR) = w.g""",
)
def protocol_labels(t: Tables) -> DataFrame:
    return packages.protocol_labels(t.orders, SPECS).select("o_orderkey", *[f"split_{s}" for s in SPECS])


@query(
    "closed_window",
    """WITH w AS (SELECT greatest(TIMESTAMP '2000-01-01', date_trunc('day', min(ts)) + INTERVAL 1 DAY) AS s FROM events)
    SELECT epoch_us(s) AS start_us, epoch_us(s + INTERVAL 7 DAYS) AS end_us, (SELECT count(*) FROM events, w WHERE ts >= s AND ts < s + INTERVAL 7 DAYS) AS rows FROM w""",
)
def closed_window(t: Tables) -> DataFrame:
    """A week that opens after the day of the first event, and how many events are in it."""
    cut = lambda f: t.events.agg(f("ts").alias("until_utc")).withColumn("rule_met", F.lit(True))
    w = packages.closed_window(cut(F.min), cut(F.max), registered="2000-01-01", earliest="2000-01-01", days=7)
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"))
    inside = e.join(F.broadcast(w), (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))  # one row
    n = inside.agg(F.count(F.lit(1)).alias("rows"), F.lit(1).alias("_1"))
    return w.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.lit(1).alias("_1")).join(n, "_1").drop("_1")


@query(
    "residual_ridge",
    f"""{SQL_DATA}, f AS (SELECT *, y * 0.9 + u / 50 AS nw, y * 0.85 + u / 40 AS tn FROM d), a AS (SELECT * FROM (VALUES (0.1::DOUBLE), (100.0::DOUBLE), (10000.0::DOUBLE)) v(alpha)),
    x AS (SELECT l_returnflag, role, q, u, y - tn AS y, alpha FROM f, a), c AS (WITH tr AS (SELECT * FROM x WHERE role = 'train'), {ridge_sql('tr', 'l_returnflag, alpha', 'alpha')},
      e AS (SELECT x.l_returnflag, x.alpha, sqrt(avg(power(my + bq * (q - mq) / sq + bu * (u - mu) / su - y, 2))) AS r FROM x JOIN m ON x.l_returnflag = m.l_returnflag AND x.alpha = m.alpha WHERE role = 'val' GROUP BY 1, 2)
      SELECT l_returnflag, arg_min(alpha, (r, alpha)) AS alpha FROM e GROUP BY 1),
    n AS (WITH tv AS (SELECT f.l_returnflag, alpha, q, u, y - nw AS y FROM f JOIN c ON c.l_returnflag = f.l_returnflag WHERE role IN ('train', 'val')), {ridge_sql('tv', 'l_returnflag, alpha', 'alpha')} SELECT * FROM m)
    SELECT f.l_returnflag, role, any_value(alpha) AS alpha, count(*) AS n, {sql_r6('avg(nw + my + bq * (q - mq) / sq + bu * (u - mu) / su)')} AS mean_prediction,
      {sql_r6('sqrt(avg(power(nw + my + bq * (q - mq) / sq + bu * (u - mu) / su - y, 2)))')} AS rmse, {sql_r6('sqrt(avg(power(nw - y, 2)))')} AS rmse_before FROM f JOIN n ON n.l_returnflag = f.l_returnflag GROUP BY 1, 2""",
)
def residual_ridge(t: Tables) -> DataFrame:
    rows = data(t).withColumns({"nw": F.col("y") * 0.9 + F.col(FEATURES[1]) / 50, "tn": F.col("y") * 0.85 + F.col(FEATURES[1]) / 40})
    out = corrections.residual_ridge(rows, FEATURES[:2], "y", nowcast="nw", train_nowcast="tn", role="role", by=["l_returnflag"], alphas=[0.1, 100.0, 10000.0])
    square = lambda p: F.sqrt(F.avg(F.pow(F.col(p) - F.col("y"), 2)))
    out = out.groupBy("l_returnflag", "role").agg(
        F.first("alpha").alias("alpha"), F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"), square("prediction").alias("rmse"), square("nw").alias("rmse_before")
    )
    return rounded(out, "mean_prediction", "rmse", "rmse_before")


@query(
    "band_corrections",
    f"""WITH b AS (SELECT l_orderkey, 'low' AS band, l_quantity / 10 * (0.8 + l_discount) AS t, l_quantity / 10 AS prior, l_extendedprice / 1e4 AS q, l_linenumber FROM lineitem WHERE l_partkey % 9 <> 0
      UNION ALL SELECT l_orderkey, 'high', l_tax * 1.1 + 0.01, l_tax, l_extendedprice / 1e4, l_linenumber FROM lineitem WHERE l_partkey % 9 <> 0),
    r AS (SELECT *, ln(greatest(prior, 1e-8)) AS u, ln(greatest(t, 1e-8) / prior) AS y FROM b WHERE prior > 0), tr AS (SELECT * FROM r WHERE l_linenumber % 2 = 1), {ridge_sql('tr', 'band', '2.0')}
    SELECT l_orderkey, r.band, {sql_r6('prior')} AS prior, {sql_r6('prior * exp(my + bq * (q - mq) / sq + bu * (u - mu) / su)')} AS corrected FROM r JOIN m ON m.band = r.band WHERE l_linenumber % 2 = 0""",
)
def band_corrections(t: Tables) -> DataFrame:
    """Two bands corrected on even lines, fitted on odd ones; bands without a prior energy take no part."""
    x = t.lineitem.withColumns({
        "t1": F.col("l_quantity") / 10 * (0.8 + F.col("l_discount")), "p1": F.col("l_quantity") / 10, "t2": F.col("l_tax") * 1.1 + 0.01, "x": F.col("l_extendedprice") / 1e4,
    })
    odd = F.col("l_linenumber") % 2 == 1
    out = corrections.band_corrections(
        x, {"low": ("t1", "p1"), "high": ("t2", "l_tax")}, ["x"], row_id="l_orderkey", complete=F.col("l_partkey") % 9 != 0, train=odd, test=~odd, alpha=2.0
    )
    return rounded(out, "prior", "corrected")


EARLY, LATER = "1997-01-01", "1998-06-01"
SQL_TRANSFER = f"""WITH o AS (SELECT o_orderkey AS sid, o_custkey AS g, CAST(o_custkey % 4 AS INT) AS fold, o_orderdate AS t, o_totalprice / 1e5 AS obs,
      o_totalprice / 1e5 * (0.7 + (o_custkey % 7) / 10.0::DOUBLE) + (o_orderkey % 1009) / 5e3 AS fc, o_totalprice / 1e5 * 0.9 + (o_orderkey % 1013) / 3e3 AS cam FROM orders),
    b AS (SELECT sid, k.k AS fold, obs, fc + 0.01::DOUBLE * k.k AS fc, cam - fc AS dis FROM o JOIN range(4) k(k) ON k.k <> o.fold WHERE t < TIMESTAMP '{EARLY}'),
    e AS (SELECT * FROM o WHERE t >= TIMESTAMP '{LATER}'),
    q AS (SELECT fold, quantile_cont(fc, 1 / 3.0::DOUBLE) AS f1, quantile_cont(fc, 2 / 3.0::DOUBLE) AS f2, quantile_cont(dis, 1 / 3.0::DOUBLE) AS d1, quantile_cont(dis, 2 / 3.0::DOUBLE) AS d2 FROM b GROUP BY 1),
    r AS (SELECT b.*, ((fc >= f1)::INT + (fc >= f2)::INT) * 3 + (dis >= d1)::INT + (dis >= d2)::INT AS cell, (fc >= f1)::INT + (fc >= f2)::INT AS one FROM b JOIN q ON q.fold = b.fold),
    k AS (SELECT fold, sum(dis * dis) / count(*) AS d2, least(greatest(sum(dis * (obs - fc)) / sum(dis * dis), 0), 1) AS c FROM r GROUP BY 1),
    c2 AS (SELECT fold, cell, sum(dis * (obs - fc)) AS x, sum(dis * dis) AS s FROM r GROUP BY 1, 2), c1 AS (SELECT fold, one, sum(dis * (obs - fc)) AS x, sum(dis * dis) AS s FROM r GROUP BY 1, 2),
    y AS (SELECT e.*, cam - fc AS dis, k.c, k.d2 AS pd, ((fc >= f1)::INT + (fc >= f2)::INT) * 3 + (cam - fc >= d1)::INT + (cam - fc >= q.d2)::INT AS cell, (fc >= f1)::INT + (fc >= f2)::INT AS one
      FROM e JOIN q ON q.fold = e.fold JOIN k ON k.fold = e.fold)"""


def _transferred(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders in four folds; the inner forecast of a fold's calibration moves with the fold it was made without."""
    y, k, c = F.col("o_totalprice") / 1e5, F.col("o_orderkey"), F.col("o_custkey")
    outer = t.orders.select(
        k.alias("sid"), c.alias("g"), (c % 4).cast("int").alias("fold"), F.col("o_orderdate").cast("timestamp").alias("t"), y.alias("obs"),
        (y * (0.7 + (c % 7) / 10.0) + (k % 1009) / 5e3).alias("fc"), (y * 0.9 + (k % 1013) / 3e3).alias("cam"),
    ).withColumn("dis", F.col("cam") - F.col("fc"))
    inner = outer.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)]))).where("k <> fold")
    pair = F.concat(F.lit("pair"), F.least("k", "fold").cast("string"), F.greatest("k", "fold").cast("string"))
    inner = inner.select("sid", "g", "fold", pair.alias("pair"), "obs", (F.col("fc") + 0.01 * F.col("k")).alias("fc"), "dis")
    return corrections.transfer(
        inner, outer, {"one_input": ["fc"], "reliability": ["fc", "dis"]}, sample="sid", group="g", fold="fold", pair="pair", observed="obs", forecast="fc", disagreement="dis",
        time="t", early_end=EARLY, later_start=LATER,
    )


@query(
    "forward_transfer",
    f"""{SQL_TRANSFER} SELECT sid, {sql_r6('fc + c * dis')} AS constant, {sql_r6('fc + least(greatest((coalesce(c1.x, 0) + 100 * pd * c) / (coalesce(c1.s, 0) + 100 * pd), 0), 1) * dis')} AS one_input,
      {sql_r6('fc + least(greatest((coalesce(c2.x, 0) + 100 * pd * c) / (coalesce(c2.s, 0) + 100 * pd), 0), 1) * dis')} AS reliability
    FROM y LEFT JOIN c1 ON c1.fold = y.fold AND c1.one = y.one LEFT JOIN c2 ON c2.fold = y.fold AND c2.cell = y.cell""",
)
def forward_transfer(t: Tables) -> DataFrame:
    return rounded(_transferred(t)[0].select("sid", "constant", "one_input", "reliability"), "constant", "one_input", "reliability")


@query(
    "forward_windows",
    f"""{SQL_TRANSFER} SELECT a.fold, calibration_rows, calibration_groups, test_rows, test_groups FROM (SELECT fold::INT AS fold, count(*) AS calibration_rows, count(DISTINCT o_custkey) AS calibration_groups FROM b JOIN orders ON o_orderkey = sid GROUP BY 1) a
    JOIN (SELECT fold, count(*) AS test_rows, count(DISTINCT g) AS test_groups FROM e GROUP BY 1) z ON z.fold = a.fold""",
)
def forward_windows(t: Tables) -> DataFrame:
    return _transferred(t)[1]
