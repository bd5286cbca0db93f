"""Queries of model grids, image measures, timing scans and validation draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..functions import geo
from ..operators import archive, images, manifest, splits
from ..sources import fields
from .registry import Tables, query, r6, rounded, sql_r6
from .solar import sun_ctes


@query(
    "melt_model_series",
    """SELECT o_orderkey, 'wave_significant_height' AS variable, 'hindcast' AS method, o_totalprice AS value FROM orders
    UNION ALL SELECT o_orderkey, 'wave_mean_from_direction', 'spectral_mean_direction', CAST((o_custkey * 7) % 360 AS DOUBLE) FROM orders WHERE o_custkey % 3 <> 0""",
)
def melt_model_series(t: Tables) -> DataFrame:
    d = F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") * 7).cast("double"))
    wide = t.orders.select("o_orderkey", F.col("o_totalprice").alias("hs"), d.alias("dir"))
    mapping = [("hs", "wave_significant_height", "hindcast"), ("dir", "wave_mean_from_direction", "spectral_mean_direction")]
    return fields.melt(wide, ["o_orderkey"], mapping)


@query(
    "coefficient_spectrum",
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice, {sql_r6('sqrt(l_discount * l_discount + l_tax * l_tax)')} AS r1,
      {sql_r6('degrees(atan2(l_tax, l_discount))')} AS alpha1 FROM lineitem""",
)
def coefficient_spectrum(t: Tables) -> DataFrame:
    b = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", (0.05 * F.col("l_linenumber")).alias("frequency_hz"), F.lit(0.05).alias("bandwidth_hz"),
        F.col("l_quantity").alias("energy_density"), F.col("l_discount").alias("a1"), F.col("l_tax").alias("b1"), F.col("l_tax").alias("a2"), F.col("l_discount").alias("b2"),
    )
    out = fields.coefficient_spectrum(b, ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", r6("r1").alias("r1"), r6("alpha1").alias("alpha1"))


@query(
    "deployment_of_record",
    """WITH d AS (SELECT user_id, ts AS s, event_id AS dep, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM events WHERE event_type = 'signup')
    SELECT v.event_id, d.dep AS deployment FROM events v LEFT JOIN d ON v.user_id = d.user_id AND v.ts >= d.s AND (d.e IS NULL OR v.ts < d.e) WHERE v.event_type = 'view'""",
)
def deployment_of_record(t: Tables) -> DataFrame:
    from ..operators.ordered import Next, ordered

    s = t.events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("start_utc"), F.col("event_id").alias("deployment"))
    d = ordered(s, ["user_id"], ["start_utc"], end_utc=Next(F.col("start_utc")))
    v = t.events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return fields.deployment_at(v, d, by=["user_id"], time="ts", values=["deployment"]).select("event_id", "deployment")


@query(
    "nearest_grid_point",
    f"""WITH s AS (SELECT s_suppkey AS site, (s_suppkey * 37) % 1200 / 10.0::DOUBLE - 60 AS lat, (s_suppkey * 101) % 3600 / 10.0::DOUBLE - 180 AS lon FROM supplier),
    p AS (SELECT c_custkey AS point, (c_custkey * 53) % 1200 / 10.0::DOUBLE - 60 AS lat, (c_custkey * 211) % 3600 / 10.0::DOUBLE - 180 AS lon FROM customer WHERE c_acctbal > 0),
    d AS (SELECT site, point, 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians(p.lat) - radians(s.lat)) / 2), 2)
      + cos(radians(s.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - s.lon) / 2), 2)))) / 1000 AS km FROM s, p)
    SELECT site, {sql_r6('min(km)')} AS distance_km FROM d GROUP BY 1""",
)
def nearest_grid_point(t: Tables) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    sites = t.supplier.select(k.alias("site"), ((k * 37) % 1200 / 10.0 - 60).alias("lat"), ((k * 101) % 3600 / 10.0 - 180).alias("lon"))
    points = t.customer.where("c_acctbal > 0").select(c.alias("point"), ((c * 53) % 1200 / 10.0 - 60).alias("lat"), ((c * 211) % 3600 / 10.0 - 180).alias("lon"))
    return rounded(fields.nearest_points(sites, points, start_km=300).drop("point"), "distance_km")


@query(
    "band_energies",
    f"""WITH b AS (SELECT l_orderkey, 0.05::DOUBLE * l_linenumber - 0.025::DOUBLE AS lo, 0.05::DOUBLE * l_linenumber + 0.025::DOUBLE AS hi, power(10.0, l_tax) * 0.5 AS e FROM lineitem)
    SELECT l_orderkey, {sql_r6('sum(e * greatest(least(hi, 0.12) - greatest(lo, 0.04), 0))')} AS swell, {sql_r6('sum(e * greatest(least(hi, 0.5) - greatest(lo, 0.12), 0))')} AS wind FROM b GROUP BY 1""",
)
def band_energies(t: Tables) -> DataFrame:
    f = 0.05 * F.col("l_linenumber")
    s = t.lineitem.select("l_orderkey", (f - 0.025).alias("edge_lo"), (f + 0.025).alias("edge_hi"), F.lit(0.5).alias("direction_width"), F.col("l_tax").alias("density"))
    return rounded(fields.band_energies(s, ["l_orderkey"], [("swell", 0.04, 0.12), ("wind", 0.12, 0.5)]), "swell", "wind")


@query(
    "camera_assets",
    """SELECT 'cam' || c_custkey AS camera, c_name AS name, c_acctbal AS lat, 'stills,video' AS products FROM customer""",
)
def camera_assets(t: Tables) -> DataFrame:
    def product(n):
        return F.struct(F.struct(F.struct(F.lit(n).alias("slug")).alias("common")).alias("data"))

    doc = F.to_json(F.struct(
        F.struct(F.struct(F.concat(F.lit("cam"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("label")).alias("common"),
                 F.struct(F.col("c_acctbal").alias("latitude"), F.lit(1.0).alias("longitude")).alias("properties")).alias("data"),
        F.array(F.struct(F.array(product("video"), product("stills")).alias("products")), F.struct(F.array(product("video")).alias("products"))).alias("feeds"),
    ))
    return fields.camera_assets(t.customer.select(doc.alias("doc")), "doc").select("camera", "name", "lat", "products")


@query(
    "index_problems",
    """SELECT count(*) FILTER (user_id % 20 = 0) AS bad_prefix, count(*) FILTER (event_id % 30 = 0) AS name_not_in_url, CAST(0 AS BIGINT) AS no_time,
      count(*) - count(DISTINCT date_trunc('minute', ts)) AS duplicate_time FROM events""",
)
def index_problems(t: Tables) -> DataFrame:
    k = F.col("event_id").cast("string")
    host = F.when(F.col("user_id") % 20 == 0, "http://x/").otherwise("https://x/")
    idx = t.events.select(F.date_trunc("minute", "ts").alias("time_utc"), F.concat(host, k).alias("url"), F.when(F.col("event_id") % 30 == 0, "other").otherwise(k).alias("name"))
    return fields.index_problems(idx, "https://")


@query(
    "view_statistics",
    f"""WITH v AS (SELECT vec_id, i.i AS view, embedding[i.i * 16 + 1 : i.i * 16 + 16] AS b FROM embeddings, range(4) i(i)), u AS (SELECT vec_id, view, unnest(b)::DOUBLE AS x FROM v)
    SELECT vec_id, CAST(view AS INT) AS view, {sql_r6('avg(x)')} AS mean, {sql_r6('stddev_pop(x)')} AS std FROM u GROUP BY 1, 2""",
)
def view_statistics(t: Tables) -> DataFrame:
    s = t.embeddings.select("vec_id", images.view_statistics("embedding", 4).alias("s"))
    return s.select("vec_id", F.posexplode_outer("s").alias("view", "v")).select("vec_id", "view", r6("v.mean").alias("mean"), r6("v.std").alias("std"))


@query(
    "usable_views",
    """WITH v AS (SELECT vec_id, i.i AS view, embedding[i.i * 16 + 1 : i.i * 16 + 16] AS b FROM embeddings, range(4) i(i)), u AS (SELECT vec_id, view, unnest(b)::DOUBLE AS x FROM v),
    s AS (SELECT vec_id, view, avg(x) AS m, stddev_pop(x) AS sd FROM u GROUP BY 1, 2)
    SELECT vec_id, CAST(count(*) FILTER (m >= 0 AND sd >= 0.1) AS INT) AS n_views FROM s GROUP BY 1""",
)
def usable_views(t: Tables) -> DataFrame:
    s = t.embeddings.select("vec_id", images.view_statistics("embedding", 4).alias("s"))
    return s.select("vec_id", images.usable_views("s", 0.0, 0.1).alias("n_views"))


@query(
    "difference_hash_bits",
    """SELECT vec_id, array_to_string(list_transform(generate_series(0, 63), lambda k: CASE WHEN g[k // 8 * 9 + k % 8 + 2] > g[k // 8 * 9 + k % 8 + 1] THEN '1' ELSE '0' END), '') AS bits
    FROM (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS g FROM embeddings)""",
)
def difference_hash_bits(t: Tables) -> DataFrame:
    """Eight rows of nine blocks, the 64 values and the first eight again: all bits."""
    grid = F.concat("embedding", F.slice("embedding", 1, 8))
    return t.embeddings.select("vec_id", F.lpad(F.bin(images.difference_hash(grid)), 64, "0").alias("bits"))


@query(
    "exclusion_reasons",
    """SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'no_position' WHEN value > 150 THEN 'spread' WHEN event_type = 'error' THEN 'no_label' END AS excluded_by FROM events""",
)
def exclusion_reasons(t: Tables) -> DataFrame:
    reasons = [("no_position", F.col("user_id") % 9 == 0), ("spread", F.col("value") > 150), ("no_label", F.col("event_type") == "error")]
    return t.events.select("event_id", manifest.first_reason(reasons).alias("excluded_by"))


@query(
    "days_since_first",
    f"""SELECT event_id, {sql_r6('(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400e6')} AS age_days FROM events""",
)
def days_since_first(t: Tables) -> DataFrame:
    return rounded(images.since_first(t.events, "user_id", "ts").select("event_id", "age_days"), "age_days")


@query(
    "motion_features",
    f"""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1), r AS (SELECT user_id, value - m AS r FROM events e JOIN m ON e.event_type = m.event_type)
    SELECT user_id, {sql_r6('avg(r)')} AS mean, {sql_r6('stddev_pop(r)')} AS std FROM r GROUP BY 1""",
)
def motion_features(t: Tables) -> DataFrame:
    return rounded(images.motion_features(t.events, "user_id", ["event_type"], "value"), "mean", "std")


@query(
    "third_gap",
    f"""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) / count(*) OVER (PARTITION BY user_id)::DOUBLE AS x, count(*) OVER (PARTITION BY user_id) AS n,
      CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END AS f FROM events),
    g AS (SELECT user_id, avg(f) FILTER (x > 2 / 3.0::DOUBLE) - avg(f) FILTER (x <= 1 / 3.0::DOUBLE) AS gap, max(n) AS n FROM r WHERE n >= 60 GROUP BY 1)
    SELECT {sql_r6('sum(gap * n) / sum(n)')} AS gap, count(*) AS n_groups FROM g""",
)
def third_gap(t: Tables) -> DataFrame:
    e = t.events.withColumn("f", F.col("event_type") == "view")
    return rounded(images.third_gap(e, "user_id", "value", "f", "event_id", 60), "gap")


@query(
    "clock_shift_scan",
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS stamp, (user_id * 7) % 100 - 50.0::DOUBLE AS lat, (user_id * 13) % 360 - 180.0::DOUBLE AS lon FROM events),
    b0 AS (SELECT *, stamp + 14400000000 AS us FROM e), {sun_ctes('b0', 'own')}, m0 AS (SELECT event_id, user_id, lat, lon, elevation > 0 AS bright, s.s AS shift_min, stamp + s.s::BIGINT * 60000000 AS us FROM own, (SELECT unnest([-240, -120, 0, 120, 240, 360]) AS s) s),
    {sun_ctes('m0', 'moved')}, w AS (SELECT user_id, shift_min, h.h AS elev, count(*) FILTER (bright <> (elevation > h.h)) AS wrong, count(*) AS n FROM moved, (SELECT unnest([-10, -8, -6, -4, -2, 0, 2]) AS h) h GROUP BY ALL),
    x AS (SELECT *, row_number() OVER (PARTITION BY user_id, elev ORDER BY wrong, abs(shift_min), shift_min) AS k FROM w), y AS (SELECT * FROM x WHERE k = 1)
    SELECT user_id, first(shift_min ORDER BY wrong, abs(shift_min), shift_min, elev) AS shift_min, min(wrong) AS wrong, any_value(n) AS n, min(shift_min) AS lowest_shift, max(shift_min) AS highest_shift FROM y GROUP BY 1""",
)
def clock_shift_scan(t: Tables) -> DataFrame:
    """Brightness follows the sun four hours later than the stamp says."""
    lat, lon = (F.col("user_id") * 7) % 100 - 50.0, (F.col("user_id") * 13) % 360 - 180.0
    e = t.events.select("event_id", "user_id", "ts", lat.alias("lat"), lon.alias("lon"))
    true, _ = geo.solar_position(F.col("ts") + F.expr("INTERVAL 4 HOURS"), "lat", "lon")
    e = e.withColumn("brightness", F.when(true > 0, 200.0).otherwise(10.0))
    return images.clock_shift_scan(
        e, time="ts", brightness="brightness", lat="lat", lon="lon", shifts_min=[-240, -120, 0, 120, 240, 360], threshold=100.0, by=["user_id"]
    )


@query(
    "storm_dates",
    """WITH RECURSIVE d AS (SELECT CAST(user_id % 20 AS BIGINT) AS site, strftime(ts, '%Y-%m-%d') AS local_day, max(value) AS hs FROM events GROUP BY 1, 2),
    b AS (SELECT *, CASE WHEN hs > 60 THEN 'high' ELSE 'mid' END AS band, CAST(least((day(CAST(local_day AS DATE)) - 1) // 10, 2) AS VARCHAR) AS period FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY site, band, period ORDER BY -hs, local_day) AS k FROM b),
    p AS (SELECT *, row_number() OVER (PARTITION BY site, band ORDER BY k, period) AS place FROM k),
    o AS (SELECT site, local_day, hs, band, period, row_number() OVER (PARTITION BY site ORDER BY place, band, local_day) AS n FROM p),
    r(site, n, kept) AS (SELECT DISTINCT site, CAST(0 AS BIGINT), CAST([] AS DATE[]) FROM o
      UNION ALL SELECT r.site, o.n, CASE WHEN len(list_filter(kept, lambda x: abs(date_diff('day', x, CAST(o.local_day AS DATE))) <= 3)) = 0
        THEN list_append(kept, CAST(o.local_day AS DATE)) ELSE kept END FROM r JOIN o ON o.site = r.site AND o.n = r.n + 1),
    f AS (SELECT site, arg_max(kept, n) AS kept FROM r GROUP BY site)
    SELECT o.site, local_day, hs, band, period, CAST(list_position(kept, CAST(local_day AS DATE)) AS BIGINT) AS rank
    FROM o JOIN f ON o.site = f.site WHERE list_contains(kept, CAST(local_day AS DATE))""",
)
def storm_dates(t: Tables) -> DataFrame:
    """The rankings of daily largest values, at least four days apart per site; thirds of a month stand for seasons."""
    day = F.date_format("ts", "yyyy-MM-dd")
    d = t.events.groupBy((F.col("user_id") % 20).alias("site"), day.alias("local_day")).agg(F.max("value").alias("hs"))
    third = F.least(F.floor((F.substring("local_day", 9, 2).cast("int") - 1) / 10), F.lit(2)).cast("string")
    d = d.withColumns({"band": F.when(F.col("hs") > 60, "high").otherwise("mid"), "period": third})
    return images.rank_interleave(d, ["site", "band"], "period", [-F.col("hs"), F.col("local_day")], "site", "local_day", 3)


@query(
    "lag_scan",
    f"""WITH s AS (SELECT epoch_us(ts) // 21600000000 * 21600000000 AS us, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
    c AS (SELECT event_id, value, l.l AS lag_s, epoch_us(ts) + l.l::BIGINT * 1000000 AS stamp FROM events, (SELECT unnest([-86400, 0, 86400]) AS l) l WHERE event_type = 'click'),
    a AS (SELECT c.*, s.us AS u0, s.v AS v0 FROM c ASOF LEFT JOIN s ON c.stamp >= s.us), b AS (SELECT a.*, s.us AS u1, s.v AS v1 FROM a ASOF LEFT JOIN s ON a.stamp <= s.us),
    i AS (SELECT lag_s, value, CASE WHEN stamp = u0 THEN v0 WHEN u1 - u0 <= 172800000000 THEN v0 + (stamp - u0) / (u1 - u0)::DOUBLE * (v1 - v0) END AS x FROM b),
    r AS (SELECT lag_s, rank() OVER (PARTITION BY lag_s ORDER BY value) + (count(*) OVER (PARTITION BY lag_s, value) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY lag_s ORDER BY x) + (count(*) OVER (PARTITION BY lag_s, x) - 1) / 2.0::DOUBLE AS rx FROM i WHERE x IS NOT NULL)
    SELECT lag_s, CASE WHEN count(*) >= 51 THEN {sql_r6('corr(rv, rx)')} END AS spearman FROM r GROUP BY 1""",
)
def lag_scan(t: Tables) -> DataFrame:
    """Rank correlation of clicks with six-hourly mean views at several lags."""
    six = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000) * 21_600_000_000)
    s = t.events.where("event_type = 'view'").groupBy(six.alias("ts")).agg(F.avg("value").alias("v"))
    c = t.events.where("event_type = 'click'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return rounded(archive.lag_scan(c, s, value="v", target_value="value", time="ts", lags_s=[-86400, 0, 86400], max_gap="2d"), "spearman")


@query(
    "latest_groups",
    """SELECT user_id, arg_max(event_id, ts) FILTER (event_type = 'view' AND ts >= TIMESTAMP '2024-01-26') AS wave_id, arg_max(value, ts) FILTER (event_type = 'click' AND ts >= TIMESTAMP '2024-01-26') AS wind
    FROM events GROUP BY 1""",
)
def latest_groups(t: Tables) -> DataFrame:
    e = t.events.select(
        "user_id", "ts", F.when(F.col("event_type") == "view", F.col("event_id")).alias("wave_id"), F.when(F.col("event_type") == "click", F.col("value")).alias("wind_speed")
    )
    out = archive.latest_groups(e, "user_id", "ts", {"wave": ["wave_id"], "wind": ["wind_speed"]}, F.lit("2024-01-31").cast("timestamp"), "5d")
    return out.select("user_id", F.col("wave.wave_id").alias("wave_id"), F.col("wind.wind_speed").alias("wind"))


@query(
    "validation_draw",
    """WITH z AS (SELECT l_suppkey AS g, count(*) AS n, sum(l_quantity * l_quantity) AS a, sum(power(l_tax * 100, 2)) AS b FROM lineitem GROUP BY 1),
    o AS (SELECT d.d, z.*, sum(n) OVER (PARTITION BY d.d ORDER BY CAST('0x' || substr(md5('0|' || d.d || '|' || g), 1, 15) AS BIGINT), g) AS cum FROM z, range(50) d(d)
      WHERE n <= (SELECT sum(n) * 0.15 FROM z)),
    k AS (SELECT * FROM o WHERE cum - n < (SELECT CAST(sum(n) * 0.15 AS BIGINT) FROM z)), s AS (SELECT d, sum(n) AS n, sum(a) AS a, sum(b) AS b FROM k GROUP BY 1),
    t AS (SELECT sum(a) AS ta, sum(b) AS tb, CAST(sum(n) * 0.15 AS BIGINT) AS target FROM z),
    w AS (SELECT arg_min(d, (abs(a / (a + b) - (ta - a) / ((ta - a) + (tb - b))), abs(n - target), d)) AS d FROM s, t WHERE n >= target AND n <= 1.15 * target)
    SELECT g AS l_suppkey FROM k WHERE d = (SELECT d FROM w)""",
)
def validation_draw(t: Tables) -> DataFrame:
    q, x = F.col("l_quantity"), F.col("l_tax") * 100
    sizes = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("stations"), F.sum(q * q).alias("sw2"), F.sum(x * x).alias("ww2"))
    target = round(t.lineitem.count() * 0.15)
    return splits.validation_draw(sizes, "l_suppkey", target=target, pool=F.lit(True), draws=50)


@query("checksum_lines", "SELECT sha256(text) || '  ' || doc_id AS value FROM documents")
def checksum_lines(t: Tables) -> DataFrame:
    return sinks.checksum_lines(t.documents.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")))
