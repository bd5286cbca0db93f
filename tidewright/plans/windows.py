"""Queries of window-mean spectra, product tables, matched triples and names on disk and in ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import window_labels
from .registry import Tables, query, rounded, sql_r6

CENTERS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30]
WIDTHS = [0.04, 0.05, 0.05, 0.05, 0.05, 0.06]
BANDS = [("swell", 0.0, 0.12), ("mid", 0.12, 0.22), ("wind", 0.22, 1.0)]


@query(
    "window_spectra",
    f"""WITH g AS (SELECT {CENTERS}::DOUBLE[] AS f, {WIDTHS}::DOUBLE[] AS w),
    r AS (SELECT event_id AS rid, user_id % 20 AS st, epoch_us(ts) AS us, 0.025::DOUBLE + 0.05::DOUBLE * (event_id % 7) AS sep,
      list_transform(range(0, 6), lambda i: CAST((event_id * (i + 3)) % 17 AS DOUBLE) / 4) AS d, list_transform(range(0, 6), lambda i: CAST((event_id * 7 + 40 * i) % 370 AS DOUBLE)) AS a,
      list_transform(range(0, 6), lambda i: CAST(event_id % 10 AS DOUBLE) / 10) AS r FROM events WHERE event_type = 'view' AND event_id % 11 <> 0),
    b AS (SELECT rid, k, d[k] AS d, d[k] * w[k] AS e, f[k] AS f, CASE WHEN sep > 0 AND sep < 1 AND sep <= f[k] THEN d[k] * w[k] ELSE 0 END AS ew, a[k] <= 360 AS good, a[k] AS a, r[k] AS r
      FROM r, g, range(1, 7) x(k)),
    s AS (SELECT rid, sum(ew) AS ew, sum(CASE WHEN good THEN ew ELSE 0 END) AS m, sum(CASE WHEN good THEN ew * r * cos(radians(a)) ELSE 0 END) AS x, sum(CASE WHEN good THEN ew * r * sin(radians(a)) ELSE 0 END) AS y,
      CASE WHEN sum(e) > 0 THEN 1 / first(f ORDER BY d DESC, k) END AS peak FROM b GROUP BY 1),
    t AS (SELECT event_id AS tid, user_id % 20 AS st, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
    p AS (SELECT tid, r.rid, (t.us - r.us) / 1e6 AS off, sep <= 0.3 AS wind FROM t JOIN r ON r.st = t.st AND abs(t.us - r.us) <= 21600000000),
    q AS (SELECT tid, count(*) AS n, first(off ORDER BY abs(off), -off, p.rid) AS off, first(peak ORDER BY abs(off), -off, p.rid) AS near, max(peak) - min(peak) AS span,
      sum(ew) AS ew, sum(m) AS m, sum(x) AS x, sum(y) AS y, bool_and(wind) AS wind FROM p JOIN s ON s.rid = p.rid GROUP BY 1),
    v AS (SELECT tid, k, f, avg(d) AS d, avg(e) AS e FROM p JOIN b ON b.rid = p.rid GROUP BY ALL),
    z AS (SELECT tid, CASE WHEN sum(e) > 0 THEN 1 / first(f ORDER BY round(d, 9) DESC, k) END AS top, sqrt(sum(e * power(2 * pi() * f, 4) / power(9.80665, 2))) AS slope,
      sqrt(sum(CASE WHEN f <= 0.21 THEN e * power(2 * pi() * f, 4) / power(9.80665, 2) ELSE 0 END)) AS low,
      sum(CASE WHEN f < 0.12 THEN e ELSE 0 END) AS swell, sum(CASE WHEN f >= 0.12 AND f < 0.22 THEN e ELSE 0 END) AS mid, sum(CASE WHEN f >= 0.22 THEN e ELSE 0 END) AS wnd FROM v GROUP BY 1)
    SELECT t.tid AS event_id, coalesce(n, 0) AS n_records, {sql_r6('off')} AS offset_s, {sql_r6('near')} AS tp_nearest_s, {sql_r6('span')} AS tp_range_s,
      {sql_r6('slope')} AS slope, {sql_r6('low')} AS slope_low, {sql_r6('swell')} AS swell_m2, {sql_r6('mid')} AS mid_m2, {sql_r6('wnd')} AS wind_m2, {sql_r6('CASE WHEN ew <> 0 THEN m / ew END')} AS coverage,
      {sql_r6('CASE WHEN m > 0 AND m >= 0.95 * ew AND wind THEN least(1.0, sqrt(x * x + y * y) / m) END')} AS wind_r1 FROM t LEFT JOIN q ON q.tid = t.tid LEFT JOIN z ON z.tid = t.tid""",
)
def window_spectra(t: Tables) -> DataFrame:
    """Clicks labelled by the mean spectrum of the views within six hours of them at the same twenty sites."""
    e, k = F.col("event_id"), F.sequence(F.lit(0), F.lit(5))
    views = t.events.where("event_type = 'view' AND event_id % 11 <> 0").select(
        e.alias("record"), (F.col("user_id") % 20).alias("site"), F.col("ts").alias("time_utc"), (0.025 + 0.05 * (e % 7)).alias("separation_hz"),
        F.transform(k, lambda i: ((e * (i + 3)) % 17).cast("double") / 4).alias("density"), F.transform(k, lambda i: ((e * 7 + 40 * i) % 370).cast("double")).alias("direction_deg"),
        F.transform(k, lambda i: (e % 10).cast("double") / 10).alias("r1"),
    )
    clicks = t.events.where("event_type = 'click'").select("event_id", (F.col("user_id") % 20).alias("site"), F.col("ts").alias("time_utc"))
    out = window_labels.window_spectra(
        clicks, views, centers=CENTERS, widths=WIDTHS, window="6h", by=["site"], target_id="event_id", record_id="record", bands=BANDS, slope_below=0.21
    )
    names = ["offset_s", "tp_nearest_s", "tp_range_s", "slope", "slope_low", "swell_m2", "mid_m2", "wind_m2", "coverage", "wind_r1"]
    return rounded(out.select("event_id", "n_records", *names), *names)


@query(
    "product_table",
    """WITH p AS (SELECT o_orderkey AS k, o_totalprice AS a FROM orders WHERE o_orderkey % 3 <> 0), q AS (SELECT l_orderkey AS k, max(l_quantity) AS b FROM lineitem WHERE l_linenumber = 2 GROUP BY 1),
    r AS (SELECT l_orderkey AS k, max(l_tax) AS c FROM lineitem WHERE l_linenumber = 5 GROUP BY 1) SELECT k, a, b, c FROM p FULL JOIN q USING (k) FULL JOIN r USING (k)""",
)
def product_table(t: Tables) -> DataFrame:
    line = lambda n, c: t.lineitem.where(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("k")).agg(F.max(c).alias("v"))
    orders = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return window_labels.product_table({"a": orders, "b": line(2, "l_quantity"), "c": line(5, "l_tax")}, ["k"], "v")


TRIPLES = """WITH e AS (SELECT *, user_id % 10 AS cam, epoch_us(date_trunc('hour', ts)) AS st FROM events),
    s AS (SELECT cam, event_id AS still, epoch_us(ts) AS us, CASE WHEN event_id % 9 = 0 THEN 'blurred' ELSE '' END AS bad, event_id % 50 AS sun FROM e WHERE event_type IN ('purchase', 'signup')),
    b AS (SELECT cam, st, bool_or(event_type = 'click') AS a, bool_or(event_type = 'view') AS b FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
    m AS (SELECT b.cam, b.st, b.a, b.b, first(s ORDER BY abs(s.us - b.st - 1800000000), s.us, CAST(s.still AS VARCHAR)) AS s FROM b LEFT JOIN s ON s.cam = b.cam GROUP BY ALL),
    o AS (SELECT cam, st AS stamp_us, s.still AS still, coalesce(s.us >= st AND s.us < st + 3600000000, false) AS inside, a, b, s.bad AS bad, s.sun AS sun FROM m),
    x AS (SELECT cam, stamp_us, still, inside, CASE WHEN NOT a THEN 'no_first' WHEN NOT b THEN 'no_second' WHEN still IS NULL THEN 'no_still' WHEN NOT inside THEN 'outside'
      WHEN bad <> '' THEN bad WHEN sun < 20 THEN 'low_sun' END AS excluded_by FROM o)"""


def _triples(t: Tables) -> DataFrame:
    cam = (F.col("user_id") % 10).alias("cam")
    product = lambda kind: t.events.where(F.col("event_type") == kind).select(cam, F.date_trunc("hour", "ts").cast("timestamp").alias("stamp"))
    bad = F.when(F.col("event_id") % 9 == 0, "blurred").otherwise("")
    stills = t.events.where("event_type IN ('purchase', 'signup')").select(cam, F.col("event_id").alias("still"), F.col("ts").cast("timestamp").alias("taken"), bad.alias("bad"), (F.col("event_id") % 50).alias("sun"))
    return window_labels.triple_match(
        product("click"), product("view"), stills, by=["cam"], stamp="stamp", window="1h", still_id="still", still_time="taken", excluded="bad", sun="sun", min_sun=20
    )


@query("triple_match", f"{TRIPLES} SELECT * FROM x")
def triple_match(t: Tables) -> DataFrame:
    return _triples(t).select("cam", F.unix_micros("stamp").alias("stamp_us"), "still", "inside", "excluded_by")


@query(
    "triple_leg_counts",
    f"""{TRIPLES}, y AS (SELECT *, excluded_by IS NULL OR excluded_by NOT IN ('no_first', 'no_second') AS two FROM x)
    SELECT cam, count(*) FILTER (two) AS stamps, count(*) FILTER (two AND inside) AS still_inside, count(*) FILTER (two AND inside AND coalesce(excluded_by, '') IN ('', 'low_sun')) AS paired,
      count(*) FILTER (excluded_by IS NULL) AS daylight FROM y GROUP BY 1""",
)
def triple_leg_counts(t: Tables) -> DataFrame:
    return window_labels.leg_counts(_triples(t), ["cam"])


@query(
    "disk_and_ledgers",
    """WITH l AS (SELECT 'f' || (event_id % 4000) || '.jpg' AS name, 'L' || (user_id % 3) AS ledger, CASE WHEN event_type IN ('view', 'click') THEN 'sha' || (user_id % 2) END AS sha256, ts, event_type AS status FROM events WHERE event_id % 5 <> 0),
    o AS (SELECT name, arg_max(sha256, (sha256 IS NOT NULL, ts)) AS sha256, arg_max(status, (sha256 IS NOT NULL, ts)) AS status, count(DISTINCT sha256) > 1 AS differ FROM l GROUP BY 1),
    g AS (SELECT name, string_agg(ledger, ',' ORDER BY since, ledger) AS ledgers FROM (SELECT name, ledger, min(ts) AS since FROM l WHERE sha256 IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    d AS (SELECT DISTINCT 'f' || (event_id % 4000) || '.jpg' AS name FROM events WHERE event_id % 2 = 0)
    SELECT coalesce(d.name, o.name) AS name, d.name IS NOT NULL AS on_disk, o.name IS NOT NULL AS in_ledger, sha256, status, ledgers, coalesce(differ, false) AS sha256_differ
    FROM d FULL JOIN o ON o.name = d.name LEFT JOIN g ON g.name = o.name""",
)
def disk_and_ledgers(t: Tables) -> DataFrame:
    """Names of four thousand files in three ledgers, every second event's file on disk."""
    name = F.concat(F.lit("f"), (F.col("event_id") % 4000).cast("string"), F.lit(".jpg"))
    sha = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("sha"), (F.col("user_id") % 2).cast("string")))
    ledger = t.events.where("event_id % 5 <> 0").select(
        F.concat(F.lit("https://x/"), name).alias("url"), sha.alias("sha256"), F.lit(1).alias("size_bytes"), F.col("ts").alias("retrieved_at"), F.col("event_type").alias("status"),
        F.concat(F.lit("L"), (F.col("user_id") % 3).cast("string")).alias("ledger"),
    )
    disk = t.events.where("event_id % 2 = 0").select(name.alias("name")).distinct().withColumn("path", F.concat(F.lit("/d/"), "name"))
    return window_labels.disk_and_ledgers(disk, ledger).select("name", "on_disk", "in_ledger", "sha256", "status", "ledgers", "sha256_differ")
