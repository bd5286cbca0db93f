"""Queries of splits, manifests, audits and station groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes, geo
from ..operators import blends, leakage, manifest, splits, stations
from ..operators.quantiles import quantiles
from .registry import Tables, query, r6, rounded, sql_r6
from .solar import light_sql, sun_ctes

SQL_ALONG = """
WITH z AS (SELECT CAST({key} AS VARCHAR) AS g, count(*) AS n FROM {source} GROUP BY 1),
m AS (SELECT g, (sum(n) OVER (ORDER BY CAST('0x' || substr(md5('{seed}|' || g), 1, 15) AS BIGINT), g) - n / 2) / (SELECT sum(n) FROM z) AS x FROM z),
w AS (SELECT g, {label} AS label FROM m)
"""


def along(key: str, source: str, a: float, b: float, c: float, seed: int = 0) -> str:
    """The parts of a line of all groups in hash order."""
    label = f"CASE WHEN x < {a} THEN 'train' WHEN x < {a + b} THEN 'val' ELSE 'test' END" if c else f"CASE WHEN x < {a} THEN 'train' ELSE 'val' END"
    return SQL_ALONG.format(key=key, source=source, seed=seed, label=label)


@query(
    "split_grouped",
    along("o_custkey", "orders", 0.7, 0.15, 0.15)
    + "SELECT o_orderkey, label AS split FROM orders JOIN w ON CAST(o_custkey AS VARCHAR) = w.g",
)
def split_grouped(t: Tables) -> DataFrame:
    return splits.grouped_split(t.orders, "o_custkey").select("o_orderkey", "split")


@query(
    "split_by_day",
    along("strftime(ts, '%Y-%m-%d')", "events", 0.6, 0.2, 0.2, 3)
    + "SELECT event_id, label AS split FROM events JOIN w ON strftime(ts, '%Y-%m-%d') = w.g",
)
def split_by_day(t: Tables) -> DataFrame:
    days = classes.add_calendar(t.events, "ts", "UTC")
    return splits.grouped_split(days, "local_day", (0.6, 0.2, 0.2), seed=3).select("event_id", "split")


@query(
    "split_time_block",
    """WITH l AS (SELECT o_orderkey, o_custkey, CASE
        WHEN (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '1999-01-31')
          OR (o_orderdate >= TIMESTAMP '2000-06-01' AND o_orderdate < TIMESTAMP '2000-07-01') THEN 'excluded'
        WHEN o_orderdate >= TIMESTAMP '2000-06-01' THEN 'test' WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'val'
        ELSE 'train' END AS s FROM orders),
    m AS (SELECT o_custkey, min(s) <> max(s) AS mixed FROM l WHERE s <> 'excluded' GROUP BY 1)
    SELECT o_orderkey, CASE WHEN coalesce(mixed, FALSE) THEN 'excluded' ELSE s END AS split
    FROM l LEFT JOIN m ON l.o_custkey = m.o_custkey""",
)
def split_time_block(t: Tables) -> DataFrame:
    return splits.time_block_split(
        t.orders, "o_orderdate", val_start="1999-01-01", test_start="2000-06-01", embargo="30d", group="o_custkey"
    ).select("o_orderkey", "split")


@query(
    "split_holdout_groups",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'test' WHEN o_orderpriority IN ('5-LOW')
       THEN 'val' ELSE 'train' END AS split FROM orders""",
)
def split_holdout_groups(t: Tables) -> DataFrame:
    return splits.holdout_split(
        t.orders, "o_orderpriority", test=["1-URGENT"], val=["5-LOW"]
    ).select("o_orderkey", "split")


@query(
    "holdout_groups_absent",
    """SELECT w AS absent FROM (VALUES ('1-URGENT'), ('9-NEVER')) v(w)
       WHERE w NOT IN (SELECT o_orderpriority FROM orders)""",
)
def holdout_groups_absent(t: Tables) -> DataFrame:
    return splits.absent_groups(t.orders, "o_orderpriority", ["1-URGENT", "9-NEVER"])


@query(
    "split_extreme",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.999) AS q FROM orders),
    x AS (SELECT o_custkey, max(o_totalprice) > (SELECT q FROM q) AS ext FROM orders GROUP BY 1),
    r AS (SELECT o.* FROM orders o JOIN x ON o.o_custkey = x.o_custkey WHERE NOT ext),"""
    + along("o_custkey", "r", 0.85, 0.15, 0.0).replace("WITH", "", 1)
    + """SELECT o_orderkey, CASE WHEN ext THEN 'test' ELSE w.label END AS split FROM orders
    JOIN x ON orders.o_custkey = x.o_custkey LEFT JOIN w ON CAST(orders.o_custkey AS VARCHAR) = w.g""",
)
def split_extreme(t: Tables) -> DataFrame:
    return splits.extreme_split(
        t.orders, "o_totalprice", quantile=0.999, group="o_custkey", val_fraction=0.15
    ).select("o_orderkey", "split")


@query(
    "leave_one_group_out",
    """SELECT o_orderpriority AS fold, count(*) AS n_test, (SELECT count(*) FROM orders) - count(*) AS n_train
       FROM orders GROUP BY 1""",
)
def leave_one_group_out(t: Tables) -> DataFrame:
    return splits.leave_one_out_sizes(t.orders, "o_orderpriority")


SQL_WEEK = "strftime(o_orderdate, '%G') || '-W' || strftime(o_orderdate, '%V')"


@query(
    "split_by_year",
    along(SQL_WEEK, "(SELECT * FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997))", 0.8, 0.2, 0.0, 1)
    + f"""SELECT o_orderkey, CASE
      WHEN year(o_orderdate) = 1998 AND o_orderdate < (SELECT min(date_trunc('day', o_orderdate)) FROM orders
        WHERE year(o_orderdate) = 1998) + INTERVAL 5 DAYS THEN 'excluded'
      WHEN year(o_orderdate) IN (1995, 1996, 1997) THEN CASE WHEN w.label = 'val' THEN 'val' ELSE 'train' END
      WHEN year(o_orderdate) = 1999 THEN 'test_later' WHEN year(o_orderdate) = 1998 THEN 'test' ELSE 'excluded' END AS split
    FROM orders LEFT JOIN w ON {SQL_WEEK} = w.g""",
)
def split_by_year(t: Tables) -> DataFrame:
    return splits.year_split(
        classes.add_calendar(t.orders, "o_orderdate", "UTC"), time="o_orderdate", train_years=[1995, 1996, 1997],
        test_years=[1998], later_years=[1999], val_fraction=0.2, seed=1, embargo="5d",
    ).select("o_orderkey", "split")


@query(
    "calendar_columns",
    """SELECT event_id, strftime(timezone('Pacific/Honolulu', timezone('UTC', ts)), '%Y-%m-%d') AS local_day,
      strftime(timezone('Pacific/Honolulu', timezone('UTC', ts)), '%G-W%V') AS local_week,
      CAST(month(timezone('Pacific/Honolulu', timezone('UTC', ts))) AS INT) AS local_month,
      CAST(year(timezone('Pacific/Honolulu', timezone('UTC', ts))) AS INT) AS local_year,
      CASE month(ts) % 12 // 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season
    FROM events""",
)
def calendar_columns(t: Tables) -> DataFrame:
    out = classes.add_calendar(t.events, "ts", "Pacific/Honolulu").withColumn("season", classes.season("ts"))
    return out.select("event_id", "local_day", "local_week", "local_month", "local_year", "season")


@query(
    "fold_packing",
    """WITH RECURSIVE z AS (SELECT CAST(o_custkey AS VARCHAR) AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) AS i FROM orders GROUP BY 1),
    r(i, load, fold) AS (SELECT CAST(0 AS BIGINT), [0, 0, 0]::BIGINT[], CAST(-1 AS BIGINT)
      UNION ALL SELECT z.i, list_transform(load, lambda x, k: CASE WHEN k = list_position(load, list_min(load)) THEN x + z.n ELSE x END), CAST(list_position(load, list_min(load)) - 1 AS BIGINT)
      FROM r JOIN z ON z.i = r.i + 1)
    SELECT o_orderkey, CAST(fold AS INT) AS cv_fold FROM orders JOIN z ON CAST(o_custkey AS VARCHAR) = z.g JOIN r ON r.i = z.i""",
)
def fold_packing(t: Tables) -> DataFrame:
    return splits.assign_folds(t.orders, ["o_custkey"], 3).select("o_orderkey", "cv_fold")


@query(
    "nested_pair_roles",
    """WITH f AS (SELECT DISTINCT o_custkey, CAST(o_custkey % 5 AS INT) AS cv_fold FROM orders),
    p AS (SELECT a, b FROM range(5) x(a), range(5) y(b) WHERE a < b)
    SELECT o_custkey, cv_fold, 'pair' || a || b AS pair, CASE WHEN cv_fold IN (a, b) THEN 'test' ELSE 'train' END AS role
    FROM f, p""",
)
def nested_pair_roles(t: Tables) -> DataFrame:
    folds = t.orders.select("o_custkey", (F.col("o_custkey") % 5).cast("int").alias("cv_fold")).distinct()
    return splits.nested_pairs(folds, "o_custkey", "cv_fold")


@query(
    "nested_calibration_rows",
    """WITH f AS (SELECT DISTINCT o_custkey, CAST(o_custkey % 5 AS INT) AS cv_fold FROM orders),
    p AS (SELECT a, b FROM range(5) x(a), range(5) y(b) WHERE a < b)
    SELECT o_custkey, cv_fold, 'pair' || a || b AS pair FROM f, p
    WHERE cv_fold IN (a, b) AND (a = 2 OR b = 2) AND cv_fold <> 2""",
)
def nested_calibration_rows(t: Tables) -> DataFrame:
    inner = nested_pair_roles(t).where("role = 'test'")
    return splits.calibration_rows(inner, 2).select("o_custkey", "cv_fold", "pair")


@query(
    "early_fit_late_test",
    """WITH r AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS role FROM orders)
    SELECT o_orderkey, role FROM r WHERE (role IN ('train', 'val') AND o_orderdate < TIMESTAMP '1998-01-01')
      OR (role = 'test' AND o_orderdate >= TIMESTAMP '1998-02-01')""",
)
def early_fit_late_test(t: Tables) -> DataFrame:
    names = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    df = t.orders.withColumn("role", F.element_at(names, (F.col("o_custkey") % 3 + 1).cast("int")))
    return splits.early_fit_late_test(
        df, "role", time="o_orderdate", group="o_custkey", fit_before="1998-01-01", test_from="1998-02-01"
    ).select("o_orderkey", "role")


@query(
    "sample_per_part",
    """SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus
        ORDER BY CAST('0x' || substr(md5('7|' || o_orderkey), 1, 15) AS BIGINT), o_orderkey) AS k FROM orders)
       WHERE k <= 50""",
)
def sample_per_part(t: Tables) -> DataFrame:
    return splits.sample_per_part(t.orders, ["o_orderstatus"], "o_orderkey", 50, seed=7).select(
        "o_orderstatus", "o_orderkey"
    )


@query(
    "mixed_fold_roles",
    """SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_roles FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""",
)
def mixed_fold_roles(t: Tables) -> DataFrame:
    return splits.mixed_roles(t.orders, "o_custkey", "o_orderstatus")


RULES = [
    {"column": "o_totalprice", "op": "between", "value": (5000.0, 450000.0)},
    {"column": "o_orderstatus", "op": "in", "value": ["O", "F"]},
    {"column": "o_orderpriority", "op": "ne", "value": "5-LOW"},
    {"column": "margin", "op": "abs_le", "value": 150000.0},
]
SQL_RULES = """
WITH o AS (SELECT *, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_totalprice - 200000 END AS margin FROM orders),
m AS (SELECT *, CASE WHEN NOT (o_totalprice BETWEEN 5000 AND 450000) THEN 'o_totalprice between (5000.0, 450000.0)'
  WHEN NOT (o_orderstatus IN ('O', 'F')) THEN 'o_orderstatus in [''O'', ''F'']'
  WHEN o_orderpriority = '5-LOW' THEN 'o_orderpriority ne ''5-LOW'''
  WHEN margin IS NULL OR abs(margin) > 150000 THEN 'margin abs_le 150000.0'
  WHEN o_custkey % 7 = 0 THEN 'label notna None' END AS excluded_by FROM o)"""


def samples(t: Tables) -> DataFrame:
    margin = F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice") - 200000)
    label = F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice"))
    return t.orders.withColumns({"margin": margin, "label": label})


@query("manifest_exclusion_ledger", f"{SQL_RULES} SELECT o_orderkey, excluded_by FROM m WHERE excluded_by IS NOT NULL")
def manifest_exclusion_ledger(t: Tables) -> DataFrame:
    return manifest.build_manifest(samples(t), id_col="o_orderkey", targets=["label"], filters=RULES)[1]


@query("manifest_kept_rows", f"{SQL_RULES} SELECT o_orderkey, o_totalprice FROM m WHERE excluded_by IS NULL")
def manifest_kept_rows(t: Tables) -> DataFrame:
    kept, _ = manifest.build_manifest(samples(t), id_col="o_orderkey", targets=["label"], filters=RULES)
    return kept.select("o_orderkey", "o_totalprice")


SQL_TIME_SPLIT = """
WITH s AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS us, CASE WHEN event_id % 5 = 0 THEN 'test'
  WHEN event_id % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM events)"""


def labelled_events(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    return t.events.withColumn("split", F.when(k == 0, "test").when(k == 1, "val").otherwise("train"))


@query(
    "leakage_shared_groups",
    """WITH s AS (SELECT o_custkey, o_orderpriority, CASE WHEN o_orderdate >= TIMESTAMP '2001-06-01' THEN 'test'
        WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'val' ELSE 'train' END AS split FROM orders),
    u AS (SELECT 'o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS "group", split FROM s
          UNION ALL SELECT 'o_orderpriority', o_orderpriority, split FROM s)
    SELECT "column", "group" FROM u GROUP BY 1, 2
    HAVING bool_or(split IN ('train', 'val')) AND bool_or(split = 'test')""",
)
def leakage_shared_groups(t: Tables) -> DataFrame:
    d = splits.time_block_split(t.orders, "o_orderdate", val_start="2001-01-01", test_start="2001-06-01")
    return leakage.shared_groups(d, ["o_custkey", "o_orderpriority"])


@query(
    "leakage_temporal_neighbours",
    f"""{SQL_TIME_SPLIT} SELECT count(*) AS temporal_neighbours FROM s a WHERE split = 'test' AND EXISTS (
      SELECT 1 FROM s b WHERE b.split = 'train' AND b.user_id = a.user_id AND abs(a.us - b.us) < 10800000000)""",
)
def leakage_temporal_neighbours(t: Tables) -> DataFrame:
    return leakage.temporal_neighbours(labelled_events(t), time="ts", min_gap="3h", by=["user_id"])


def sign_hash(vector: str):
    """64 sign bits of a vector as one integer (the last dimension is the sign bit)."""
    powers = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    bits = F.zip_with(vector, powers, lambda x, p: F.when(x > 0, p).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def hashed_vectors(t: Tables) -> DataFrame:
    side = F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train")
    return t.embeddings.select("vec_id", sign_hash("embedding").alias("hash"), side.alias("split"))


@query(
    "leakage_near_duplicates",
    """WITH h AS (SELECT vec_id, [x > 0 FOR x IN embedding] AS b, vec_id % 3 = 0 AS test FROM embeddings)
    SELECT d AS distance, count(*) AS n_pairs FROM (SELECT len(list_filter(list_zip(a.b, c.b), lambda z: z[1] <> z[2])) AS d
      FROM h a, h c WHERE a.test AND NOT c.test) WHERE d <= 17 GROUP BY 1""",
)
def leakage_near_duplicates(t: Tables) -> DataFrame:
    """Test and train vectors whose sign bits differ in at most seventeen places."""
    h = hashed_vectors(t)
    pairs = leakage.near_duplicates(
        h.where("split = 'test'"), h.where("split = 'train'"), "hash", max_hamming=17, bands=6
    )
    return pairs.groupBy("distance").agg(F.sum("n_pairs").alias("n_pairs"))


@query(
    "leakage_adjacent_days",
    """WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE day(ts) % 7 = 0),
    r AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE day(ts) % 7 > 2)
    SELECT count(*) AS adjacent_days FROM s WHERE d IN (SELECT d FROM r) OR d - 1 IN (SELECT d FROM r) OR d + 1 IN (SELECT d FROM r)""",
)
def leakage_adjacent_days(t: Tables) -> DataFrame:
    k = F.dayofmonth("ts") % 7
    side = F.when(k == 0, "test").when(k > 2, "train").otherwise("excluded")
    return leakage.adjacent_days(t.events.withColumn("split", side), "ts")


@query(
    "leakage_report",
    f"""{SQL_TIME_SPLIT}, g AS (SELECT count(*) AS n FROM (SELECT user_id FROM s GROUP BY 1
        HAVING bool_or(split IN ('train', 'val')) AND bool_or(split = 'test'))),
    n AS (SELECT count(*) AS n FROM s a WHERE split = 'test' AND EXISTS (SELECT 1 FROM s b WHERE b.split = 'train'
        AND b.user_id = a.user_id AND abs(a.us - b.us) < 3600000000))
    SELECT g.n AS shared_groups, n.n AS temporal_neighbours, CAST(0 AS BIGINT) AS near_duplicate_pairs,
      g.n + n.n = 0 AS ok FROM g, n""",
)
def leakage_report(t: Tables) -> DataFrame:
    return leakage.leakage_report(
        labelled_events(t), groups=["user_id"], time="ts", by=["user_id"], min_gap="1h"
    )


def sites(t: Tables) -> DataFrame:
    """Suppliers placed on the sphere by their key."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        F.lpad(k.cast("string"), 6, "0").alias("station_id"), "s_nationkey",
        ((k * 37) % 1200 / 10.0 - 60).alias("lat"), ((k * 101) % 3600 / 10.0 - 180).alias("lon"),
    )


SQL_SITES = """
WITH RECURSIVE st AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id, s_nationkey,
  (s_suppkey * 37) % 1200 / 10.0::DOUBLE - 60 AS lat, (s_suppkey * 101) % 3600 / 10.0::DOUBLE - 180 AS lon FROM supplier),
pr AS (SELECT a.id AS a, b.id AS b, 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) / 1000 AS km
  FROM st a, st b WHERE a.id < b.id)"""


@query(
    "station_distance_pairs",
    f"{SQL_SITES} SELECT a, b, {sql_r6('km')} AS distance_km FROM pr WHERE km <= 1500",
)
def station_distance_pairs(t: Tables) -> DataFrame:
    return rounded(stations.distance_pairs(sites(t), max_km=1500), "distance_km")


@query(
    "station_spatial_groups",
    f"""{SQL_SITES}, e AS (SELECT a, b FROM pr WHERE km <= 1200 UNION ALL SELECT b, a FROM pr WHERE km <= 1200),
    r(id, seen) AS (SELECT id, id FROM st UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
    SELECT id AS station_id, 'g' || min(seen) AS station_group FROM r GROUP BY id""",
)
def station_spatial_groups(t: Tables) -> DataFrame:
    return stations.spatial_groups(sites(t), km=1200)


@query(
    "station_positions",
    f"""WITH l AS (SELECT user_id AS station_id, 20 + value / 100 AS lat, 150 + (event_id % 100) / 1000.0::DOUBLE AS lon FROM events),
    m AS (SELECT station_id, quantile_cont(lat, 0.5) AS la, quantile_cont(lon, 0.5) AS lo FROM l GROUP BY 1)
    SELECT l.station_id, {sql_r6('min(la)')} AS lat, {sql_r6('min(lo)')} AS lon, {sql_r6('''max(2 * 6371008.8 * asin(sqrt(least(1.0,
      power(sin((radians(la) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * power(sin(radians(lo - lon) / 2), 2)))))''', 3)}
      AS max_move_m, count(*) AS n FROM l JOIN m ON l.station_id = m.station_id GROUP BY 1""",
)
def station_positions(t: Tables) -> DataFrame:
    l = t.events.select(
        F.col("user_id").alias("station_id"), (20 + F.col("value") / 100).alias("lat"),
        (150 + (F.col("event_id") % 100) / 1000.0).alias("lon"),
    )
    return rounded(rounded(stations.station_positions(l), "lat", "lon"), "max_move_m", digits=3)


@query(
    "exact_quantiles",
    f"""SELECT event_type, {sql_r6('quantile_cont(value, 0.1)')} AS p10, {sql_r6('quantile_cont(value, 0.5)')} AS p50,
      {sql_r6('quantile_cont(value, 0.9)')} AS p90 FROM events GROUP BY 1""",
)
def exact_quantiles(t: Tables) -> DataFrame:
    q = quantiles(t.events, ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return rounded(q, "p10", "p50", "p90")


@query(
    "swell_share",
    f"""SELECT o_orderpriority, {sql_r6('sum(power(o_totalprice / 1e4, 2)) / sum(power(o_totalprice / 1e4, 2) + power(o_custkey / 1e2, 2))')}
      AS swell_share FROM orders GROUP BY 1""",
)
def swell_share(t: Tables) -> DataFrame:
    d = t.orders.withColumns({"sw": F.col("o_totalprice") / 1e4, "ww": F.col("o_custkey") / 1e2})
    return rounded(stations.swell_share(["o_orderpriority"], "sw", "ww", d), "swell_share")


@query(
    "solar_geometry",
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, (user_id * 7) % 120 - 60.0::DOUBLE AS lat, (user_id * 13) % 360 - 180.0::DOUBLE AS lon FROM events), {sun_ctes('e')},
    r AS (SELECT event_id, user_id, {sql_r6('elevation')} AS elevation, {sql_r6('azimuth')} AS azimuth FROM sun)
    SELECT *, {light_sql('elevation')} AS light, elevation > 0 AND elevation < 35 AND abs(azimuth + 90 - 360 * floor((azimuth + 90) / 360) - 180) <= 30 AS glint FROM r""",
)
def solar_geometry(t: Tables) -> DataFrame:
    """Sun position and light category per event; the position comes from the user's key."""
    lat, lon = (F.col("user_id") * 7) % 120 - 60.0, (F.col("user_id") * 13) % 360 - 180.0
    e, a = geo.solar_position("ts", lat, lon)
    d = t.events.select("event_id", "user_id", r6(e).alias("elevation"), r6(a).alias("azimuth"))
    return d.withColumns(
        {"light": geo.illumination("elevation"), "glint": geo.glint_risk("elevation", "azimuth", 90.0, 60.0)}
    )


@query(
    "geodesy",
    f"""WITH p AS (SELECT s_suppkey, (s_suppkey * 37) % 1200 / 10.0::DOUBLE - 60 AS lat, (s_suppkey * 101) % 3600 / 10.0::DOUBLE - 180 AS lon FROM supplier),
    b AS (SELECT *, degrees(atan2(sin(radians(10 - lon)) * cos(radians(20)), cos(radians(lat)) * sin(radians(20))
        - sin(radians(lat)) * cos(radians(20)) * cos(radians(10 - lon)))) AS d FROM p)
    SELECT s_suppkey, {sql_r6('CASE WHEN d < 0 THEN d + 360 ELSE d END')} AS bearing,
      {sql_r6('lon + 300 - 360 * floor((lon + 480) / 360)')} AS wrapped FROM b""",
)
def geodesy(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    lat, lon = (k * 37) % 1200 / 10.0 - 60, (k * 101) % 3600 / 10.0 - 180
    return t.supplier.select(
        "s_suppkey", r6(geo.initial_bearing_deg(lat, lon, F.lit(20.0), F.lit(10.0))).alias("bearing"),
        r6(geo.wrap_longitude(lon + 300)).alias("wrapped"),
    )


@query(
    "degraded_control",
    """WITH c AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority
        ORDER BY o_orderkey) AS k, row_number() OVER (PARTITION BY o_orderpriority
        ORDER BY CAST('0x' || substr(md5('5|' || o_orderkey), 1, 15) AS BIGINT), o_orderkey) AS h FROM orders)
    SELECT a.o_orderkey, b.o_orderkey AS donor, b.v AS o_totalprice_degraded FROM c a JOIN c b ON a.g = b.g AND a.k = b.h""",
)
def degraded_control(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return blends.degraded_control(d, ["o_orderpriority"], "o_orderkey", ["o_totalprice"], seed=5).select(
        "o_orderkey", "donor", "o_totalprice_degraded"
    )
