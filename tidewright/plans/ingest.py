"""Queries of the parsers: station texts are written from the tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import spectra
from ..sources import ledgers, listings, stations
from .registry import Tables, query, r6, rounded, sql_r6

HEAD_RT = "#YY  MM DD hh mm WSPD WVHT MWD VIS"
UNITS_RT = "#yr  mo dy hr mn m/s    m  degT nmi"
HEAD_OLD = "YY MM DD hh WD WSPD WVHT"


def station_lines(t: Tables) -> DataFrame:
    """A realtime file per even user and a two-digit-year historical file per odd user."""
    e = t.events
    even = F.col("user_id") % 2 == 0
    file = F.concat(F.lit("s"), F.col("user_id").cast("string"), F.when(even, ".txt").otherwise("h1998.txt.gz"))
    v = F.col("value")
    speed = F.when(v > 100, "MM").otherwise(F.format_string("%.2f", v))
    realtime = F.concat_ws(" ", F.date_format("ts", "yyyy MM dd HH mm"), speed, F.format_string("%.3f", v / 10),
                           (F.col("event_id") % 400).cast("string"), F.when(v < 1, "MM").otherwise("2.0"))
    height = F.when(v > 50, "99.00").otherwise(F.format_string("%.3f", v / 10))
    old = F.concat_ws(" ", F.lit("98"), F.date_format("ts", "MM dd HH"), F.when(v > 30, "999").otherwise("99"),
                      F.when(v < 20, "99.0").otherwise(F.format_string("%.2f", v)), height)
    data = e.select(file.alias("file"), F.when(even, realtime).otherwise(old).alias("line"))
    files = e.select(file.alias("file"), even.alias("even")).distinct()
    heads = files.select("file", F.when(F.col("even"), HEAD_RT).otherwise(HEAD_OLD).alias("line"))
    units = files.where("even").select("file", F.lit(UNITS_RT).alias("line"))
    return data.unionByName(heads).unionByName(units)


SQL_STATION = """
WITH e AS (SELECT event_id, user_id, user_id % 2 = 0 AS even, ts, value AS v,
    's' || user_id || CASE WHEN user_id % 2 = 0 THEN '.txt' ELSE 'h1998.txt.gz' END AS file,
    CASE WHEN user_id % 2 = 0 THEN epoch_us(date_trunc('minute', ts))
      ELSE epoch_us(make_timestamp(1998, month(ts), day(ts), hour(ts), 0, 0.0)) END AS us FROM events),
l AS (SELECT file, us, 'WSPD' AS "column", CASE WHEN even THEN CASE WHEN v > 100 THEN NULL WHEN round(v, 2) = 99 THEN NULL ELSE v END
      WHEN v < 20 OR round(v, 2) = 99 THEN NULL ELSE v END AS value, 'm/s' AS unit FROM e
  UNION ALL SELECT file, us, 'WVHT', CASE WHEN even THEN CAST(printf('%.3f', v / 10) AS DOUBLE) WHEN v > 50 THEN NULL ELSE CAST(printf('%.3f', v / 10) AS DOUBLE) END, 'm' FROM e
  UNION ALL SELECT file, us, 'MWD', event_id % 400, 'degT' FROM e WHERE even
  UNION ALL SELECT file, us, 'VIS', CASE WHEN v < 1 THEN NULL ELSE 2.0 END, 'nmi' FROM e WHERE even
  UNION ALL SELECT file, us, 'WDIR', CASE WHEN v > 30 THEN NULL ELSE 99 END, 'degT' FROM e WHERE NOT even)"""


@query(
    "parse_station_table",
    f"""{SQL_STATION} SELECT file, us, "column", count(*) AS n, count(value) AS n_values, {sql_r6('sum(value)', 2)} AS total, max(unit) AS unit
    FROM l GROUP BY 1, 2, 3""",
)
def parse_station_table(t: Tables) -> DataFrame:
    rows = stations.parse_table(station_lines(t))
    return rows.groupBy("file", F.unix_micros("time_utc").alias("us"), "column").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), r6(F.sum("value"), 2).alias("total"), F.max("unit").alias("unit")
    )


def observations(t: Tables) -> DataFrame:
    long = stations.parse_table(station_lines(t)).select(
        F.regexp_extract("file", "^s([0-9]+)(\\.|h)", 1).alias("station_id"), "time_utc", "column", "value", "unit",
        F.col("file").alias("source_file"),
    )
    return schema.to_observations(long, schema.STATION_COLUMNS, dataset="ndbc", product="stdmet")


@query(
    "normalise_observations",
    f"""{SQL_STATION}, o AS (SELECT CASE "column" WHEN 'WSPD' THEN 'wind_speed' WHEN 'WVHT' THEN 'wave_significant_height'
        WHEN 'MWD' THEN 'wave_from_direction_at_peak' WHEN 'VIS' THEN 'visibility' ELSE 'wind_from_direction' END AS variable,
      CASE WHEN "column" = 'VIS' THEN value * 1852 WHEN unit = 'degT' THEN value - 360 * floor(value / 360) ELSE value END AS value FROM l WHERE value IS NOT NULL)
    SELECT variable, CASE variable WHEN 'wind_speed' THEN 'm s-1' WHEN 'visibility' THEN 'm' WHEN 'wave_significant_height' THEN 'm' ELSE 'degree' END AS units,
      count(*) AS n, {sql_r6('sum(value)', 2)} AS total, {sql_r6('max(value)', 2)} AS largest FROM o GROUP BY 1, 2""",
)
def normalise_observations(t: Tables) -> DataFrame:
    return observations(t).groupBy("variable", "units").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 2).alias("total"), r6(F.max("value"), 2).alias("largest")
    )


@query(
    "observation_ids",
    """SELECT 'ndbc:' || user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS observation_id FROM events""",
)
def observation_ids(t: Tables) -> DataFrame:
    return t.events.select(
        schema.observation_id(
            "ndbc", F.col("user_id").cast("string"), F.col("event_type"), schema.iso_utc(F.col("ts").cast("timestamp"))
        ).alias("observation_id")
    )


@query(
    "schema_violations",
    """SELECT 'null station_id' AS "check", count(*) AS n FROM events WHERE user_id % 50 = 0
    UNION ALL SELECT 'unknown variable', count(*) FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'angle outside [0, 360)', count(*) FROM events WHERE event_type = 'view' AND value * 4 >= 360
    UNION ALL SELECT 'invalid project_qc_flag', count(*) FROM events WHERE event_id % 100 = 7""",
)
def schema_violations(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    variable = F.when(kind == "error", "magic").when(kind == "view", "wind_from_direction").otherwise("wind_speed")
    flag = F.when(F.col("event_id") % 100 == 7, 5).otherwise(1)
    rows = t.events.select(
        F.col("event_id").cast("string").alias("observation_id"), F.lit("ndbc").alias("dataset_id"),
        F.when(F.col("user_id") % 50 != 0, F.col("user_id").cast("string")).alias("station_id"),
        F.col("ts").cast("timestamp").alias("time_utc"), variable.alias("variable"),
        F.when(kind == "view", "degree").otherwise("m s-1").alias("units"), (F.col("value") * 4).alias("value"),
        F.lit("f").alias("source_file"), F.lit("1").alias("processing_version"), flag.alias("project_qc_flag"),
    )
    return schema.violations(schema.coerce(rows))


@query(
    "parse_spectral_summary",
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(date_trunc('minute', ts)) AS us, value AS v FROM events)
    SELECT 's' || user_id || '.spec' AS file, us, sum(CASE WHEN v > 100 THEN NULL ELSE CAST(printf('%.2f', v) AS DOUBLE) END) AS swh,
      sum(CASE WHEN event_id % 17 = 16 THEN NULL ELSE (event_id % 17) * 22.5 END)::DOUBLE AS swd,
      max(CASE WHEN v > 50 THEN 'STEEP' END) AS steepness FROM e GROUP BY 1, 2""",
)
def parse_spectral_summary(t: Tables) -> DataFrame:
    v = F.col("value")
    points = F.array(*[F.lit(p) for p in (*stations.COMPASS, "MM")])
    line = F.concat_ws(" ", F.date_format("ts", "yyyy MM dd HH mm"), F.when(v > 100, "MM").otherwise(F.format_string("%.2f", v)),
                       F.element_at(points, (F.col("event_id") % 17 + 1).cast("int")), F.when(v > 50, "STEEP").otherwise("N/A"))
    file = F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit(".spec"))
    data = t.events.select(file.alias("file"), line.alias("line"))
    heads = data.select("file").distinct()
    lines = data.unionByName(heads.select("file", F.lit("#YY  MM DD hh mm SwH SwD STEEPNESS").alias("line")))
    lines = lines.unionByName(heads.select("file", F.lit("#yr  mo dy hr mn   m   -     -").alias("line")))
    rows = stations.parse_summary(lines)

    def pick(c: str, v: str):
        return F.when(F.col("column") == c, F.col(v))

    return rows.groupBy("file", F.unix_micros("time_utc").alias("us")).agg(
        F.sum(pick("SwH", "value")).alias("swh"), F.sum(pick("SwD", "value")).alias("swd"), F.max(pick("STEEPNESS", "category")).alias("steepness")
    )


@query(
    "parse_realtime_spectra",
    f"""SELECT l_orderkey AS station, round(0.05 * l_linenumber::DOUBLE, 5) AS f, count(*) AS n, {sql_r6('sum(CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END)', 2)} AS s,
      {sql_r6('max(l_discount)')} AS sep FROM lineitem GROUP BY 1, 2""",
)
def parse_realtime_spectra(t: Tables) -> DataFrame:
    """One line per order line with a single pair; quantities above 45 carry the missing marker."""
    q = F.when(F.col("l_quantity") > 45, "999.0").otherwise(F.format_string("%.3f", "l_quantity"))
    line = F.concat(F.date_format("l_shipdate", "yyyy MM dd HH mm "), F.format_string("%.3f ", "l_discount"), q,
                    F.format_string(" (%.3f) ", 0.05 * F.col("l_linenumber")))
    data = t.lineitem.select(F.col("l_orderkey").cast("string").alias("file"), line.alias("line"))
    lines = data.unionByName(
        data.select("file", F.lit("#YY  MM DD hh mm Sep_Freq  < spec_1 (freq_1) spec_2 (freq_2) ... >").alias("line")).distinct()
    )
    rows = stations.parse_spectral_pairs(lines, "swden")
    return rows.groupBy(F.col("file").cast("bigint").alias("station"), F.col("frequency_hz").alias("f")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 2).alias("s"), r6(F.max("separation_hz")).alias("sep")
    )


@query(
    "parse_spectral_matrix",
    f"""SELECT l_suppkey AS station, k.k::INT AS bin, round(0.033 + 0.005 * k.k::DOUBLE, 5) AS f, count(*) AS n,
      {sql_r6('sum(CASE k.k WHEN 0 THEN l_quantity WHEN 1 THEN (CASE WHEN l_tax > 0.07 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END) ELSE l_discount * 100 END / 100)', 4)} AS s
    FROM lineitem, range(3) k(k) GROUP BY 1, 2, 3""",
)
def parse_spectral_matrix(t: Tables) -> DataFrame:
    """Historical r1 files: three bins, values scaled by 100."""
    line = F.concat_ws(" ", F.date_format("l_shipdate", "yyyy MM dd HH mm"), F.format_string("%.2f", "l_quantity"),
                       F.when(F.col("l_tax") > 0.07, "999.00").otherwise(F.format_string("%d.00", "l_linenumber")),
                       F.format_string("%.2f", F.col("l_discount") * 100))
    data = t.lineitem.select(F.col("l_suppkey").cast("string").alias("file"), line.alias("line"))
    lines = data.unionByName(data.select("file", F.lit("#YY  MM DD hh mm  .0330  .0380  .0430").alias("line")).distinct())
    rows = stations.parse_spectral_matrix(lines, "swr1")
    return rows.groupBy(F.col("file").cast("bigint").alias("station"), "bin", F.col("frequency_hz").alias("f")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("s")
    )


@query(
    "parse_current_profile",
    """WITH v AS (SELECT user_id AS station, b.b::INT AS bin, CASE WHEN b.b = 2 AND event_id % 5 = 0 THEN NULL ELSE b.b * 10.0 END AS d,
      (event_id % 90) * 1.0 AS dir FROM events, range(1, 4) b(b) WHERE NOT (b.b = 3 AND event_id % 2 = 0))
    SELECT station, bin, count(*) AS n, count(d) AS n_depth, sum(dir)::DOUBLE AS dir FROM v GROUP BY 1, 2""",
)
def parse_current_profile(t: Tables) -> DataFrame:
    k = (F.col("event_id") % 90).cast("string")
    second = F.when(F.col("event_id") % 5 == 0, "999.0").otherwise("20.0")
    third = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit(" 30.0 "), k, F.lit(" 7.0"))).otherwise("")
    line = F.concat(F.date_format("ts", "yyyy MM dd HH mm "), F.lit("10.0 "), k, F.lit(" 5.5 "), second, F.lit(" "), k, F.lit(" 6.5"), third)
    data = t.events.select(F.col("user_id").cast("string").alias("file"), line.alias("line"))
    lines = data.unionByName(data.select("file", F.lit("#YY  MM DD hh mm DEP01 DIR01 SPD01").alias("line")).distinct())
    rows = stations.parse_profile(lines)
    return rows.groupBy(F.col("file").cast("bigint").alias("station"), "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count("depth_m").alias("n_depth"), F.sum("direction_deg").alias("dir")
    )


@query(
    "assemble_spectrum",
    f"""WITH d AS (SELECT l_orderkey, 0.05 * l_linenumber::DOUBLE AS f, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2),
    a AS (SELECT l_orderkey, 0.05 * l_linenumber::DOUBLE AS f, arg_min(l_extendedprice, l_extendedprice) AS v FROM lineitem WHERE l_tax > 0.02 GROUP BY 1, 2)
    SELECT d.l_orderkey, {sql_r6('d.f')} AS frequency_hz, d.s AS density, a.v AS alpha1 FROM d LEFT JOIN a ON d.l_orderkey = a.l_orderkey AND d.f = a.f""",
)
def assemble_spectrum(t: Tables) -> DataFrame:
    f = (0.05 * F.col("l_linenumber")).alias("frequency_hz")
    den = t.lineitem.groupBy("l_orderkey", f).agg(F.sum("l_quantity").alias("density"))
    alpha = t.lineitem.where("l_tax > 0.02").select("l_orderkey", f, F.col("l_extendedprice").alias("value"), F.col("l_extendedprice").alias("line_no"))
    return rounded(spectra.join_products(den, ["l_orderkey"], alpha1=alpha), "frequency_hz")


@query(
    "derived_observations",
    """WITH s AS (SELECT l_orderkey, l_linenumber AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
    g AS (SELECT l_orderkey, 4 * sqrt(sum(q * 0.05)) AS v FROM s GROUP BY 1)
    SELECT 'wave_significant_height' AS variable, 'spectral_hm0' AS method, 'm' AS units, count(*) AS n, (round(sum(v) + 1e-10, 3) + 0.0) AS total FROM g""",
)
def derived_observations(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey", (0.05 * F.col("l_linenumber")).alias("frequency_hz")).agg(
        F.sum("l_quantity").alias("spectral_density_m2_hz")
    ).withColumn("bandwidth_hz", F.lit(0.05))
    bulk = spectra.bulk_parameters(s, ["l_orderkey"]).select(F.col("l_orderkey").cast("string").alias("station"), "Hm0", F.timestamp_seconds(F.lit(0)).alias("time"))
    obs = schema.derived_observations(bulk, dataset="ndbc", station="station", time="time", source_file=F.lit("x"))
    return obs.groupBy("variable", "method", "units").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 3).alias("total"))


@query(
    "merge_snapshots",
    """WITH s AS (SELECT user_id AS station, epoch_us(date_trunc('day', ts)) AS us, event_id AS snapshot, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS hs,
        CASE WHEN event_type = 'click' THEN NULL ELSE value * 2 END AS tp FROM events)
    SELECT station, us, arg_max(hs, snapshot) FILTER (hs IS NOT NULL) AS hs, arg_max(tp, snapshot) FILTER (tp IS NOT NULL) AS tp, max(snapshot) AS snapshot,
      count(*) AS n_snapshots, coalesce(max(hs) - min(hs), 0) > 0.05 AS snapshots_disagree FROM s GROUP BY 1, 2""",
)
def merge_snapshots(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    rows = t.events.select(
        F.col("user_id").alias("station"), F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")).alias("us"), F.col("event_id").alias("snapshot"),
        F.when(kind != "error", F.col("value")).alias("hs"), F.when(kind != "click", F.col("value") * 2).alias("tp"),
    )
    return stations.merge_snapshots(rows, ["station", "us"], ["hs", "tp"], "hs")


@query(
    "page_links",
    r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages)
    SELECT page_id, CAST(i - 1 AS INT) AS position, h[i] AS href, l[i] AS label FROM m, unnest(generate_series(1, len(h))) g(i)""",
)
def page_links(t: Tables) -> DataFrame:
    return listings.parse_links(t.pages, "html", "page_id")


def index_pages(t: Tables) -> DataFrame:
    """One index page per order: its archive file, a size in K or M, and a realtime file."""
    year = F.year("o_orderdate").cast("string")
    codes = F.array(*[F.lit(c) for c in ("h", "w", "d", "i", "j", "k")])
    dirs = F.array(*[F.lit(d) for d in ("stdmet", "swden", "swdir", "swdir2", "swr1", "swr2")])
    i = (F.col("o_orderkey") % 6 + 1).cast("int")
    station = F.concat(F.lit("x"), (F.col("o_custkey") % 40).cast("string"))
    variant = F.when(F.col("o_orderkey") % 7 == 0, "b").otherwise("")
    name = F.concat(station, F.element_at(codes, i), variant, year, F.lit(".txt.gz"))
    size = F.when(F.col("o_orderstatus") == "P", "-").otherwise(
        F.concat((F.col("o_custkey") % 9 + 1).cast("string"), F.when(F.col("o_orderstatus") == "O", "K").otherwise("M"))
    )

    def row(n, s):
        return F.concat(F.lit('<tr><td><a href="'), n, F.lit('">'), n, F.lit('</a></td><td align="right">'),
                        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), F.lit('  </td><td align="right">'), s, F.lit("</td></tr>"))

    rt = F.concat(station, F.lit(".data_spec"))
    return t.orders.select("o_orderkey", F.element_at(dirs, i).alias("dir"), F.concat(row(name, size), row(rt, F.lit("12"))).alias("html"))


SQL_INDEX = """
WITH n AS (SELECT o_orderkey, 'x' || o_custkey % 40 AS st, (o_orderkey % 6)::INT AS i, CASE WHEN o_orderkey % 7 = 0 THEN 'b' ELSE '' END AS va, year(o_orderdate) AS y,
    date_trunc('minute', o_orderdate) AS m, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN (o_custkey % 9 + 1) * 1024.0 ELSE (o_custkey % 9 + 1) * 1048576.0 END::DOUBLE AS sz FROM orders),
f AS (SELECT *, ['stdmet', 'swden', 'swdir', 'swdir2', 'swr1', 'swr2'][i + 1] AS product, st || ['h', 'w', 'd', 'i', 'j', 'k'][i + 1] || va || y || '.txt.gz' AS name FROM n)"""


@query(
    "directory_listing",
    f"""{SQL_INDEX} SELECT o_orderkey, name, epoch_us(m) AS us, sz AS size_bytes FROM f
    UNION ALL SELECT o_orderkey, st || '.data_spec', epoch_us(m), 12.0 FROM f""",
)
def directory_listing(t: Tables) -> DataFrame:
    out = listings.parse_directory(index_pages(t), "html", "o_orderkey")
    return out.select("o_orderkey", "name", F.unix_micros("last_modified").alias("us"), "size_bytes")


def inventory(t: Tables) -> DataFrame:
    listing = listings.parse_directory(index_pages(t), "html", "dir")
    hist, _ = listings.historical_inventory(listing, "dir")
    return hist.unionByName(listings.realtime_inventory(listing))


@query(
    "inventory_files",
    f"""{SQL_INDEX} SELECT upper(st) AS station_id, product, y || va AS period, CASE va WHEN '' THEN 'a' ELSE va END AS segment, y AS year,
      'historical' AS archive, count(*) AS n FROM f GROUP BY ALL
    UNION ALL SELECT upper(st), 'swden', 'realtime', NULL, NULL, 'realtime', count(*) FROM f GROUP BY 1""",
)
def inventory_files(t: Tables) -> DataFrame:
    keys = ["station_id", "product", "period", "segment", "year", "archive"]
    return inventory(t).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "availability_matrix",
    f"""{SQL_INDEX} SELECT upper(st) AS station_id, {", ".join(f"count(DISTINCT y) FILTER (product = '{p[0]}') AS {p[0]}" for p in listings.PRODUCTS if p[3])}
    FROM f GROUP BY 1""",
)
def availability_matrix(t: Tables) -> DataFrame:
    return listings.availability_matrix(inventory(t))


@query(
    "station_summary",
    f"""{SQL_INDEX}, s AS (SELECT st, y FROM f WHERE product <> 'stdmet' GROUP BY 1, 2 HAVING count(DISTINCT product) = 5)
    SELECT upper(f.st) AS station_id, count(DISTINCT y) FILTER (product = 'stdmet') AS stdmet_years, min(y) FILTER (product = 'stdmet') AS stdmet_first,
      max(y) FILTER (product = 'stdmet') AS stdmet_last, 'swden' AS realtime_products, (SELECT count(*) FROM s WHERE s.st = f.st) AS full_spectrum_years
    FROM f GROUP BY f.st""",
)
def station_summary(t: Tables) -> DataFrame:
    return listings.station_summary(inventory(t), ["stdmet"])


@query(
    "station_xml",
    """SELECT 'S' || s_suppkey AS station_id, s_name AS name, s_acctbal AS elevation_m, s_nationkey % 2 = 0 AS has_met, FALSE AS is_dart FROM supplier""",
)
def station_xml(t: Tables) -> DataFrame:
    met = F.when(F.col("s_nationkey") % 2 == 0, "y").otherwise("n")
    e = F.format_string('<station id="s%s" name="%s" elev="%s" met="%s" dart="n"/>', F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string"), met)
    return listings.parse_station_xml(t.supplier.select(e.alias("x")), "x").select("station_id", "name", "elevation_m", "has_met", "is_dart")


@query(
    "station_table_rows",
    """SELECT upper('s' || c_nationkey) AS station_id, arg_min(c_mktsegment, c_custkey) AS owner_code, arg_min(c_name || ' & co', c_custkey) AS table_name
    FROM customer GROUP BY 1""",
)
def station_table_rows(t: Tables) -> DataFrame:
    line = F.concat_ws(" | ", F.concat(F.lit("s"), F.col("c_nationkey").cast("string")), "c_mktsegment", F.lit(""), F.lit(""), F.concat("c_name", F.lit(" &amp; co")))
    out = listings.parse_station_table(t.customer.select("c_custkey", line.alias("line")), "line", "c_custkey")
    return out.select("station_id", "owner_code", "table_name")


@query(
    "camera_list",
    """SELECT 'C' || c_custkey AS station_id, c_name AS camera_name, c_acctbal AS latitude, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'A' || c_custkey || '.jpg' END AS latest_image,
      480 AS image_width FROM customer""",
)
def camera_list(t: Tables) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    img = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("A"), k, F.lit(".jpg")))
    doc = F.to_json(F.array(F.struct(F.concat(F.lit("c"), k).alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("lat"), img.alias("img"), F.lit(480).alias("width"))))
    out = listings.parse_camera_list(t.customer.select(doc.alias("doc")), "doc")
    return out.select("station_id", "camera_name", "latitude", "latest_image", "image_width")


@query(
    "image_elements",
    """WITH e AS (SELECT 'https://x/' || user_id || '/' || (event_id % 400) || '.jpg' AS url, epoch_us(ts) AS us, (event_id % 400) || '.jpg' AS name, event_id FROM events)
    SELECT url, min(us) AS us, arg_min(name, us) AS name, arg_min(event_id, us) AS size_bytes FROM e GROUP BY 1""",
)
def image_elements(t: Tables) -> DataFrame:
    name = F.concat((F.col("event_id") % 400).cast("string"), F.lit(".jpg"))
    url = F.concat(F.lit("https://x/"), F.col("user_id").cast("string"), F.lit("/"), name)
    doc = F.to_json(F.struct(F.struct(
        F.struct(name.alias("label")).alias("common"),
        F.struct(url.alias("url"), F.col("event_id").cast("string").alias("size")).alias("properties"),
        F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("min")).alias("temporal")).alias("extents"),
    ).alias("data")))
    out = listings.parse_elements(t.events.select(doc.alias("doc")), "doc")
    return out.select("url", F.unix_micros("time_utc").alias("us"), "name", "size_bytes")


@query(
    "image_names",
    """SELECT event_id, 'CAM' || user_id AS camera, epoch_us(date_trunc('minute', ts)) AS us, 'CAM' || user_id || strftime(ts, '_%Y_%m_%d_%H%M.jpg') AS name,
      user_id || strftime(ts, '/%Y/%m/') || 'CAM' || user_id || strftime(ts, '_%Y_%m_%d_%H%M.jpg') AS path FROM events""",
)
def image_names(t: Tables) -> DataFrame:
    name = listings.image_name(F.concat(F.lit("CAM"), F.col("user_id").cast("string")), F.col("ts"))
    e = t.events.select("event_id", "user_id", name.alias("name"))
    return e.select(
        "event_id", listings.image_camera("name").alias("camera"), F.unix_micros(listings.image_time("name")).alias("us"), "name",
        listings.image_path(F.col("user_id").cast("string"), F.col("name")).alias("path"),
    )


@query(
    "forecast_bulletins",
    """SELECT 'S' || o_custkey AS station_id, epoch_us(date_trunc('day', o_orderdate)) AS issue_us, CAST(h.h AS INT) AS lead_h, count(*) AS n,
      (round(sum((o_orderkey % 50) / 10.0::DOUBLE) + 1e-10, 3) + 0.0) AS hs, CAST(2 AS INT) AS systems, TRUE AS wind
    FROM orders, range(7) h(h) WHERE o_orderkey % 9 <> 0 GROUP BY 1, 2, 3""",
)
def forecast_bulletins(t: Tables) -> DataFrame:
    rows = listings.parse_bulletins(bulletins(t), "doc")
    return rows.groupBy("station_id", F.unix_micros("issue_utc").alias("issue_us"), "lead_h").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("hs_m"), 3).alias("hs"), F.max("systems").alias("systems"),
        F.max(F.col("wave_systems")[0]["wind"]).alias("wind"),
    )


@query(
    "forecast_bulletins_rejected",
    "SELECT DISTINCT 'S' || o_custkey AS station_id, epoch_us(date_trunc('day', o_orderdate)) AS issue_us FROM orders WHERE o_orderkey % 9 = 0",
)
def forecast_bulletins_rejected(t: Tables) -> DataFrame:
    bad = listings.bad_bulletins(bulletins(t), "doc")
    return bad.select("station_id", F.unix_micros("issue_utc").alias("issue_us"))


def bulletins(t: Tables) -> DataFrame:
    """One bulletin per order; every ninth skips an hour and is rejected."""
    day = F.date_trunc("day", "o_orderdate")
    hours = F.transform(
        F.sequence(F.lit(0), F.lit(8)),
        lambda h: F.concat(
            F.lit("| "), F.date_format(day, "dd"), F.lit(" "),
            F.when((F.col("o_orderkey") % 9 == 0) & (h == 3), F.lit("17")).otherwise(h.cast("string")),
            F.lit(" | "), F.format_string("%.1f", (F.col("o_orderkey") % 50) / 10), F.lit(" 2 | * 1.0 8.0 270 | 0.5 12.1 180 | | | | |"),
        ),
    )
    head = F.concat(F.lit(" Location : S"), F.col("o_custkey").cast("string"), F.lit("\n Cycle : "), F.date_format(day, "yyyyMMdd"), F.lit(" 0 UTC\n"))
    doc = F.concat(head, F.array_join(hours, "\n"), F.lit("\n"))
    return t.orders.select(doc.alias("doc"))


@query(
    "ledger_lines",
    """SELECT user_id AS station, count(*) FILTER (event_id % 11 <> 0) AS good, count(*) FILTER (event_id % 11 = 0) AS bad,
      count(*) FILTER (event_id % 13 = 0) * 2 AS nul_bytes, CAST(coalesce(sum(event_id) FILTER (event_id % 11 <> 0), 0) AS BIGINT) AS bytes FROM events GROUP BY 1""",
)
def ledger_lines(t: Tables) -> DataFrame:
    """Ledger text with cut lines and NUL bytes."""
    k = F.col("event_id").cast("string")
    nul = F.when(F.col("event_id") % 13 == 0, "\u0000\u0000").otherwise("")
    full = F.concat_ws(",", F.lit("src"), F.lit("image"), F.col("user_id").cast("string"), F.lit("2024"), F.concat(F.lit("https://x/"), k), F.lit("p"),
                       F.concat(F.lit("ab"), nul), k, F.lit("200"), F.lit(""), F.lit(""), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("verified"), F.lit("1"), F.lit(""))
    cut = F.concat(F.concat_ws(",", F.lit("src"), F.lit("image"), F.col("user_id").cast("string")), nul)
    lines = t.events.select("user_id", F.when(F.col("event_id") % 11 == 0, cut).otherwise(full).alias("line"))
    rows = ledgers.split_lines(lines)
    return rows.groupBy(F.col("user_id").alias("station")).agg(
        F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"), F.sum("nul_bytes").cast("bigint").alias("nul_bytes"),
        F.coalesce(F.sum(F.when(~F.col("bad"), F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
    )
