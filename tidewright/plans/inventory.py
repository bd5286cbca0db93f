"""Queries of the inventory: station lists, references, wave stations, profilers, registry, camera sets, hours, rejected lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes, clips
from ..operators import crossings, inventory
from ..sources import listings, providers, stations
from .ingest import SQL_STATION, bulletins, station_lines
from .registry import Tables, query, r6, rounded, sql_r6


@query(
    "merged_station_lists",
    """WITH a AS (SELECT 'S' || c_custkey AS station_id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS owner FROM customer WHERE c_custkey % 3 <> 0),
    b AS (SELECT 'S' || c_custkey AS station_id, 'T' || c_nationkey AS table_name, 'O' || c_nationkey AS owner FROM customer WHERE c_custkey % 5 <> 0)
    SELECT station_id, name, coalesce(a.owner, b.owner) AS owner, table_name FROM a FULL JOIN b USING (station_id)""",
)
def merged_station_lists(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("S"), k.cast("string")).alias("station_id")
    xml = t.customer.where(k % 3 != 0).select(name, F.col("c_name").alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("owner"))
    nation = lambda p: F.concat(F.lit(p), F.col("c_nationkey").cast("string"))
    table = t.customer.where(k % 5 != 0).select(name, nation("T").alias("table_name"), nation("O").alias("owner"))
    return inventory.merge_station_lists(xml, table).select("station_id", "name", "owner", "table_name")


@query(
    "site_references",
    f"""WITH st AS (SELECT 'S' || s_suppkey AS id, s_name AS name, s_suppkey % 60 - 30.0::DOUBLE AS lat, (s_suppkey * 7) % 300 - 150.0::DOUBLE AS lon FROM supplier),
    r AS (SELECT o_orderkey AS site_id, o_orderkey % 50 - 25.0::DOUBLE AS slat, o_orderkey % 340 - 170.0::DOUBLE AS slon, 'S' || l_suppkey AS id, CASE WHEN l_linenumber = 2 THEN 10.0::DOUBLE END AS lat, CASE WHEN l_linenumber = 2 THEN 20.0::DOUBLE END AS lon
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    j AS (SELECT site_id, r.id, st.name, slat, slon, coalesce(r.lat, st.lat) AS lat, coalesce(r.lon, st.lon) AS lon FROM r JOIN st ON st.id = r.id)
    SELECT site_id, id AS station_id, name, lat, lon, round(2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(lat - slat) / 2), 2) + cos(radians(slat)) * cos(radians(lat)) * power(sin(radians(lon - slon) / 2), 2)))) / 1000 , 1) AS distance_km FROM j""",
)
def site_references(t: Tables) -> DataFrame:
    """Orders are camera sites, the suppliers of their lines the references; second lines carry a position of their own."""
    sup = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    known = t.supplier.select(sup("s_suppkey").alias("station_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 60 - 30.0).alias("lat"), ((F.col("s_suppkey") * 7) % 300 - 150.0).alias("lon"))
    own = lambda v: F.when(F.col("l_linenumber") == 2, F.lit(v))
    k = F.col("l_orderkey")
    refs = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(
        k.alias("site_id"), (k % 50 - 25.0).alias("site_lat"), (k % 340 - 170.0).alias("site_lon"), F.lower(sup("l_suppkey")).alias("station_id"),
        F.lit(None).cast("string").alias("name"), own(10.0).alias("lat"), own(20.0).alias("lon"),
    )
    out = inventory.resolve_references(refs, known)
    return out.select("site_id", F.upper("station_id").alias("station_id"), "name", "lat", "lon", "distance_km")


SQL_FILES = """WITH f AS (SELECT 'S' || (user_id % 400) AS station_id, CAST(2000 + event_id % 6 AS BIGINT) AS year, event_id,
      CASE event_type WHEN 'view' THEN 'stdmet' WHEN 'click' THEN 'swden' WHEN 'purchase' THEN 'adcp' WHEN 'signup' THEN 'adcp2' ELSE 'cwind' END AS product,
      CASE WHEN event_id % 10 = 0 THEN 'realtime' ELSE 'historical' END AS archive, CASE WHEN event_id % 4 = 0 THEN 'b' ELSE 'a' END AS segment FROM events),
    st AS (SELECT 'S' || s_suppkey AS station_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name || CASE WHEN s_suppkey % 7 = 0 THEN ' (134)' ELSE '' END END AS name, 'T' || s_suppkey AS table_name,
      CASE WHEN s_suppkey % 5 = 0 THEN 'SCRIPPS' WHEN s_suppkey % 5 = 1 THEN 'NDBC' END AS owner, CASE WHEN s_suppkey % 13 <> 0 THEN s_acctbal END AS latitude, s_acctbal / 2 AS longitude FROM supplier)"""


def _files(t: Tables) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    product = F.when(kind == "view", "stdmet").when(kind == "click", "swden").when(kind == "purchase", "adcp").when(kind == "signup", "adcp2").otherwise("cwind")
    return t.events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 400).cast("string")).alias("station_id"), (2000 + e % 6).cast("bigint").alias("year"), product.alias("product"),
        F.when(e % 10 == 0, "realtime").otherwise("historical").alias("archive"), F.when(e % 4 == 0, "b").otherwise("a").alias("segment"),
        F.concat(F.lit("f"), e.cast("string")).alias("filename"),
    )


def _stations(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    text = k.cast("string")
    name = F.when(k % 3 != 0, F.concat("s_name", F.when(k % 7 == 0, " (134)").otherwise("")))
    owner = F.when(k % 5 == 0, "SCRIPPS").when(k % 5 == 1, "NDBC")
    return t.supplier.select(
        F.concat(F.lit("S"), text).alias("station_id"), name.alias("name"), F.concat(F.lit("T"), text).alias("table_name"), owner.alias("owner"),
        F.when(k % 13 != 0, F.col("s_acctbal")).alias("latitude"), (F.col("s_acctbal") / 2).alias("longitude"),
    )


@query(
    "wave_stations",
    f"""{SQL_FILES}, h AS (SELECT * FROM f WHERE archive = 'historical' AND year = 2002),
    m AS (SELECT *, coalesce(name, table_name) AS label, coalesce(owner = 'SCRIPPS', false) OR regexp_matches(coalesce(name, table_name), '\\([0-9]{{3}}\\)\\s*$') AS member FROM st WHERE latitude IS NOT NULL)
    SELECT m.station_id, min('f' || event_id) AS filename, any_value(label) AS label, any_value(CASE WHEN member THEN 'CDIP' ELSE coalesce(owner, '') END) AS network, any_value(latitude) AS latitude, any_value(longitude) AS longitude
    FROM m JOIN h ON h.station_id = m.station_id AND product = 'stdmet' AND segment = 'a'
    WHERE member OR m.station_id IN (SELECT station_id FROM h WHERE product = 'swden') GROUP BY 1""",
)
def wave_stations(t: Tables) -> DataFrame:
    return inventory.wave_stations(_files(t), _stations(t), 2002)


@query(
    "profiler_availability",
    f"""{SQL_FILES}, h AS (SELECT * FROM f WHERE archive = 'historical'), a AS (SELECT DISTINCT station_id, year FROM h WHERE product IN ('adcp', 'adcp2')), s AS (SELECT DISTINCT station_id, year FROM h WHERE product = 'swden')
    SELECT a.station_id, min(a.year) AS adcp_first, max(a.year) AS adcp_last, count(*) AS adcp_years, count(s.year) AS adcp_and_spectrum_years, any_value(st.name) AS name
    FROM a LEFT JOIN s USING (station_id, year) LEFT JOIN st ON st.station_id = a.station_id GROUP BY 1""",
)
def profiler_availability(t: Tables) -> DataFrame:
    return inventory.profiler_availability(_files(t), _stations(t).select("station_id", "name"))


@query(
    "registry_problems",
    """WITH e AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 29 <> 0 THEN 'd' || (p_partkey - CASE WHEN p_partkey % 31 = 0 THEN 1 ELSE 0 END) END AS id, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END AS name, p_brand AS provider,
      CASE p_partkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'documented' WHEN 2 THEN 'candidate' WHEN 3 THEN CASE WHEN p_partkey % 3 = 0 THEN 'rumoured' ELSE 'candidate' END END AS status, p_partkey % 8 = 0 AS bare FROM part),
    n AS (SELECT *, coalesce(id, '#' || pos) AS dataset_id FROM e)
    SELECT dataset_id, 'dataset_id: missing' AS problem FROM n WHERE id IS NULL UNION ALL SELECT dataset_id, 'name: missing' FROM n WHERE name = ' '
    UNION ALL SELECT dataset_id, 'status: unknown' FROM n WHERE status = 'rumoured' UNION ALL SELECT dataset_id, 'verified without evidence' FROM n WHERE status = 'verified' AND bare
    UNION ALL SELECT id, 'duplicate dataset_id' FROM n WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
)
def registry_problems(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    ident = F.when(k % 29 != 0, F.concat(F.lit("d"), (k - F.when(k % 31 == 0, 1).otherwise(0)).cast("string")))
    status = F.when(k % 4 == 0, "verified").when(k % 4 == 1, "documented").when((k % 4 == 3) & (k % 3 == 0), "rumoured").otherwise("candidate")
    entries = t.part.select(
        k.alias("position"), ident.alias("dataset_id"), F.when(k % 17 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("provider"),
        status.alias("status"), F.when(k % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("https://x/"))).alias("evidence"),
    )
    return inventory.registry_problems(entries)


@query(
    "camera_sets",
    """WITH s AS (SELECT DISTINCT 'r' || n_regionkey AS st, n_nationkey AS place, n_name AS camera FROM nation),
    x AS (SELECT c_nationkey AS list, c_custkey AS pos, coalesce(s.place, 0) AS place, coalesce(s.camera, 'cam' || (c_custkey % 40)) AS camera
      FROM customer LEFT JOIN s ON c_custkey % 3 = 0 AND s.st = 'r' || (c_custkey % 5))
    SELECT list, camera, first(pos ORDER BY pos, place) AS position, first(place ORDER BY pos, place)::BIGINT AS place FROM x GROUP BY 1, 2""",
)
def camera_sets(t: Tables) -> DataFrame:
    """Every nation's customers are a list of cameras; every third one is a set, the nations of a region."""
    k = F.col("c_custkey")
    label = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    sets = t.nation.select(label("r", F.col("n_regionkey")).alias("set"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("camera"))
    names = t.customer.select(F.col("c_nationkey").alias("list"), k.alias("position"), F.when(k % 3 == 0, label("@r", k % 5)).otherwise(label("cam", k % 40)).alias("name"))
    return inventory.expand_sets(names, sets)


@query(
    "cameras_this_hour",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id % 30, date_trunc('hour', ts)) AS cameras_this_hour FROM events""",
)
def cameras_this_hour(t: Tables) -> DataFrame:
    e = t.events.select("event_id", (F.col("user_id") % 30).alias("station_id"), F.date_trunc("hour", "ts").alias("hour"))
    return inventory.listed_this_hour(e, ["station_id"], "hour").select("event_id", "cameras_this_hour")


@query(
    "other_camera_offset",
    f"""WITH e AS (SELECT event_id, event_type AS camera, user_id % 30 AS st, date_trunc('hour', ts) AS h, epoch_us(ts) AS us FROM events),
    g AS (SELECT st, h, (min(us) FILTER (camera = 'view') - min(us) FILTER (camera = 'click')) / 1e6 AS gap FROM e WHERE camera IN ('view', 'click') GROUP BY 1, 2)
    SELECT event_id, {sql_r6("gap * CASE camera WHEN 'view' THEN 1 WHEN 'click' THEN -1 END")} AS other_camera_offset_s FROM e LEFT JOIN g ON g.st = e.st AND g.h = e.h""",
)
def other_camera_offset(t: Tables) -> DataFrame:
    e = t.events.select("event_id", (F.col("user_id") % 30).alias("st"), F.date_trunc("hour", "ts").alias("h"), F.col("event_type").alias("camera"), F.col("ts").cast("timestamp").alias("time_utc"))
    out = inventory.other_camera_offset(e, ["st"], "h", "camera", "time_utc", ("view", "click"))
    return rounded(out.select("event_id", "other_camera_offset_s"), "other_camera_offset_s")


@query(
    "previous_hour_record",
    f"""WITH h AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS level FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT event_id, {sql_r6('level')} AS level, CASE WHEN level IS NULL THEN 'missing' ELSE 'ok' END AS status FROM events LEFT JOIN h ON h.h = date_trunc('hour', ts) - INTERVAL 1 HOUR WHERE event_type <> 'view'""",
)
def previous_hour_record(t: Tables) -> DataFrame:
    """The mean level of the hour before each event."""
    views = t.events.where("event_type = 'view'")
    hourly = views.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("level"))
    out = inventory.attach_previous_hour(t.events.where("event_type <> 'view'").select("event_id", "ts"), "ts", hourly, "hour")
    return out.select("event_id", r6("level").alias("level"), F.when(F.col("level").isNull(), "missing").otherwise("ok").alias("status"))


def placed_lines(t: Tables) -> DataFrame:
    """Station lines in their places, with a later header of other columns that must not count."""
    lines = station_lines(t)
    head, units = F.col("line").rlike("^#?YY\\s"), F.col("line").startswith("#yr")
    placed = lines.withColumn("place", F.when(head, 0).when(units, 1).otherwise(2).cast("bigint"))
    late = placed.where(head).select("file", F.lit("YYYY MM DD hh VIS WVHT WSPD").alias("line"), F.lit(3).cast("bigint").alias("place"))
    return placed.unionByName(late)


@query(
    "station_rows_by_place",
    f"""{SQL_STATION} SELECT file, "column", count(*) AS n, count(value) AS n_values, {sql_r6('sum(value)', 2)} AS total, max(unit) AS unit FROM l GROUP BY 1, 2""",
)
def station_rows_by_place(t: Tables) -> DataFrame:
    rows = stations.parse_table(placed_lines(t))
    return rows.groupBy("file", "column").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), r6(F.sum("value"), 2).alias("total"), F.max("unit").alias("unit"))


SQL_BROKEN = """WITH e AS (SELECT event_id, 'k' || user_id || '.txt' AS file, user_id, CASE WHEN event_id % 13 = 0 THEN '2024 13 01 00 00 ' ELSE strftime(ts, '%Y %m %d %H %M ') END || event_id AS line FROM events)"""


@query(
    "station_rejected_lines",
    f"""{SQL_BROKEN} SELECT file, event_id AS place, line, CASE WHEN user_id % 10 = 3 THEN 'no header' ELSE 'bad time' END AS reason FROM e WHERE user_id % 10 = 3 OR event_id % 13 = 0""",
)
def station_rejected_lines(t: Tables) -> DataFrame:
    """Files of some users have no header, every thirteenth line has a thirteenth month."""
    file = F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit(".txt"))
    time = F.when(F.col("event_id") % 13 == 0, "2024 13 01 00 00").otherwise(F.date_format("ts", "yyyy MM dd HH mm"))
    rows = t.events.select(file.alias("file"), F.concat_ws(" ", time, F.col("event_id").cast("string")).alias("line"), F.col("event_id").alias("place"))
    heads = t.events.where("user_id % 10 <> 3").select(file.alias("file")).distinct().select("file", F.lit("#YY  MM DD hh mm MWD").alias("line"), F.lit(-1).cast("bigint").alias("place"))
    return stations.rejected_lines(rows.unionByName(heads))


@query(
    "incomplete_records",
    "SELECT l_orderkey, count(*) FILTER (l_partkey % 50 = 0) AS n_missing FROM lineitem GROUP BY 1 HAVING n_missing > 0",
)
def incomplete_records(t: Tables) -> DataFrame:
    return crossings.incomplete_records(t.lineitem.withColumn("x", F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity"))), ["l_orderkey"], "x")


PROVIDER = providers.StationFiles()


def _station_files(t: Tables) -> DataFrame:
    """A realtime file for each user, with heights that rise by steps."""
    file = F.concat(F.lit("/data/b"), F.col("user_id").cast("string"), F.lit(".txt"))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy MM dd HH mm"), F.format_string("%.3f", F.col("value") / 10), F.format_string("%.1f", 4.0 + F.col("event_id") % 9))
    data = t.events.select(file.alias("file"), line.alias("line"), F.col("event_id").alias("place"))
    files = t.events.select(file.alias("file")).distinct()
    head = files.select("file", F.lit("#YY  MM DD hh mm WVHT DPD").alias("line"), F.lit(-2).cast("bigint").alias("place"))
    units = files.select("file", F.lit("#yr  mo dy hr mn m sec").alias("line"), F.lit(-1).cast("bigint").alias("place"))
    return data.unionByName(head).unionByName(units)


SQL_PROVIDER = """WITH e AS (SELECT 'B' || user_id AS station_id, epoch_us(date_trunc('minute', ts)) AS us, CAST(printf('%.3f', value / 10) AS DOUBLE) AS h, 4.0::DOUBLE + event_id % 9 AS p FROM events),
    v AS (SELECT station_id, us, CASE WHEN abs(h - 99) > 1e-8 + 1e-5 * 99 THEN h END AS h, p FROM e)"""


@query(
    "provider_observations",
    f"""{SQL_PROVIDER}, o AS (SELECT station_id, 'wave_significant_height' AS variable, h AS value FROM v WHERE h IS NOT NULL UNION ALL SELECT station_id, 'wave_peak_period', p FROM v)
    SELECT station_id, variable, count(*) AS n, {sql_r6('sum(value)', 2)} AS total FROM o GROUP BY 1, 2""",
)
def provider_observations(t: Tables) -> DataFrame:
    out = providers.ingest_lines(PROVIDER, _station_files(t), "stdmet").observations
    return out.groupBy("station_id", "variable").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 2).alias("total"))


@query(
    "provider_flags",
    f"""{SQL_PROVIDER}, g AS (SELECT station_id, us, max(h) AS h, max(p) AS p FROM v GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN h IS NULL THEN 9 WHEN h < 0 OR h > 25 THEN 4 WHEN h < 0.05 OR h > 15 THEN 3 ELSE 1 END AS range_flag FROM g)
    SELECT station_id, count(*) AS n, count(*) FILTER (range_flag = 3) AS suspect_range, count(*) FILTER (range_flag = 4) AS failed_range FROM r GROUP BY 1""",
)
def provider_flags(t: Tables) -> DataFrame:
    flags = providers.ingest_lines(PROVIDER, _station_files(t), "stdmet").flags
    return flags.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("range_flag") == 3).alias("suspect_range"), F.count_if(F.col("range_flag") == 4).alias("failed_range"))


@query(
    "published_classes",
    """SELECT o_orderkey, CASE WHEN h < 1.52 THEN 0 WHEN h > 3.05 THEN 1 END AS two_classes,
      CASE WHEN 0.631 * h >= 0.75 AND 0.631 * h < 3.25 THEN (0.631 * h >= 1.25)::INT + (0.631 * h >= 1.75)::INT + (0.631 * h >= 2.25)::INT + (0.631 * h >= 2.75)::INT END AS five_classes
    FROM (SELECT o_orderkey, o_totalprice / 1e5 AS h FROM orders)""",
)
def published_classes(t: Tables) -> DataFrame:
    h = F.col("o_totalprice") / 1e5
    return t.orders.select("o_orderkey", classes.gap_class(h, 1.52, 3.05).alias("two_classes"), classes.scaled_class(h, 0.631, [0.75, 1.25, 1.75, 2.25, 2.75, 3.25]).alias("five_classes"))


@query(
    "clip_windows",
    """WITH c AS (SELECT event_id, value * 4 AS s, user_id % 40 AS k FROM events), m AS (SELECT *, CASE WHEN k >= 1 THEN least(k - 1, CAST(floor(s / 2 / 16) AS BIGINT)) END AS mid FROM c)
    SELECT event_id, mid, CASE WHEN mid IS NOT NULL THEN greatest(0, least(mid - 5, greatest(k - 11, 0))) END AS first, CASE WHEN mid IS NOT NULL THEN least(k, greatest(0, least(mid - 5, greatest(k - 11, 0))) + 11) END AS "end" FROM m""",
)
def clip_windows(t: Tables) -> DataFrame:
    c = t.events.select("event_id", (F.col("value") * 4).alias("s"), (F.col("user_id") % 40).alias("k")).withColumn("mid", clips.midpoint_window("s", "k"))
    first, end = clips.centred_windows("mid", "k")
    there = F.col("mid").isNotNull()
    return c.select("event_id", "mid", F.when(there, first).alias("first"), F.when(there, end).alias("end"))


@query(
    "onpremise_images",
    """SELECT 'cam' AS camera, epoch_us(date_trunc('second', ts)) AS us, 'timex.cam-' || strftime(ts, '%Y-%m-%d-%H%M%S') || 'Z.jpg' AS name, 'https://x/' || 'timex.cam-' || strftime(ts, '%Y-%m-%d-%H%M%S') || 'Z.jpg' AS url, event_id AS size_bytes
    FROM events WHERE event_type = 'view' AND event_id % 7 <> 0""",
)
def onpremise_images(t: Tables) -> DataFrame:
    """Views are images of one camera, other events of another; every seventh name is a leftover of editing."""
    stamp = F.date_format("ts", "yyyy-MM-dd-HHmmss")
    camera = F.when(F.col("event_type") == "view", "cam").otherwise("cam2")
    name = F.concat(F.lit("timex."), camera, F.lit("-"), stamp, F.when(F.col("event_id") % 7 == 0, "Z_old.jpg").otherwise("Z.jpg"))
    listing = t.events.select(name.alias("name"), F.lit(False).alias("is_dir"), F.col("event_id").alias("size_bytes"))
    out = listings.onpremise_images(listing, "cam", "https://x/", "timex.")
    return out.select("camera", F.unix_micros("time_utc").alias("us"), "name", "url", "size_bytes")


@query(
    "selected_bulletins",
    """SELECT 'S' || o_custkey AS station_id, epoch_us(date_trunc('day', o_orderdate)) AS issue_us, CAST(h.h AS INT) AS lead_h, count(*) AS n
    FROM orders, range(7) h(h) WHERE o_orderkey % 9 <> 0 AND o_custkey IN (1, 2, 4, 5, 7, 8, 10, 11) GROUP BY 1, 2, 3""",
)
def selected_bulletins(t: Tables) -> DataFrame:
    station = F.regexp_extract("doc", "Location : (S[0-9]+)", 1)
    docs = bulletins(t).withColumn("path", F.concat(F.lit("cycle/gfswave."), station, F.lit(".bull")))
    out = listings.selected_bulletins(docs, "doc", "path", [f"S{i}" for i in (1, 2, 4, 5, 7, 8, 10, 11)])
    return out.groupBy("station_id", F.unix_micros("issue_utc").alias("issue_us"), "lead_h").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tier_counts",
    """WITH e AS (SELECT *, value / 100 AS h FROM events WHERE event_id % 9 <> 0)
    SELECT event_type, CASE WHEN h < 0.5 THEN -1 ELSE (h >= 0.5)::INT + (h >= 1.25)::INT + (h >= 2.5)::INT - 1 END AS class, count(*) AS clips, count(DISTINCT CAST(ts AS DATE)) AS dates, count(DISTINCT (user_id, date_trunc('hour', ts))) AS windows
    FROM e GROUP BY 1, 2""",
)
def tier_counts(t: Tables) -> DataFrame:
    e = t.events.select("event_type", "user_id", F.when(F.col("event_id") % 9 != 0, F.col("value") / 100).alias("h"), F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"))
    return inventory.tier_counts(e, "h", [0.5, 1.25, 2.5], day="day", window=["user_id", "hour"], by=["event_type"])


@query(
    "stage_coverage",
    """WITH e AS (SELECT *, event_id % 3 <> 0 AS a, value > 10 AS b, event_type = 'view' AS c FROM events)
    SELECT 0 AS position, 'listed' AS stage, count(*) AS rows, count(DISTINCT user_id) AS groups, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM e WHERE a
    UNION ALL SELECT 1, 'measured', count(*), count(DISTINCT user_id), epoch_us(min(ts)), epoch_us(max(ts)) FROM e WHERE a AND b UNION ALL SELECT 2, 'scored', count(*), count(DISTINCT user_id), epoch_us(min(ts)), epoch_us(max(ts)) FROM e WHERE a AND b AND c""",
)
def stage_coverage(t: Tables) -> DataFrame:
    stages = {"listed": F.col("event_id") % 3 != 0, "measured": F.col("value") > 10, "scored": F.col("event_type") == "view"}
    out = inventory.stage_coverage(t.events.withColumn("time", F.col("ts").cast("timestamp")), stages, group="user_id", time="time")
    return out.select("position", "stage", "rows", "groups", F.unix_micros("first_utc").alias("first_us"), F.unix_micros("last_utc").alias("last_us"))
