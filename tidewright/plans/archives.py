"""Queries of archive integrity, coverage and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import archive
from ..sources import ledgers
from .registry import Tables, query, r6, rounded, sql_r6
from .solar import light_sql, sun_ctes

HOUR = 3_600_000_000


@query(
    "latest_by_url",
    """SELECT user_id AS url, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def latest_by_url(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("url"), "event_id", "ts", "value", F.when(F.col("event_type") != "error", "sha").alias("sha256")
    )
    return ledgers.latest_by_url(rows, ["ts", "event_id"]).select("url", "event_id", "value")


SQL_FILES = """
WITH files AS (SELECT doc_id, 'd/' || doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE length(text) END AS size, sha256(text) AS sha, doc_id % 19 = 0 AS nul FROM documents),
led AS (SELECT 'd/' || doc_id AS path, length(text) AS size, CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'd/' || doc_id, CASE WHEN doc_id % 11 = 0 THEN length(text) ELSE length(text) + 1 END, sha256(text) FROM documents WHERE doc_id % 2 = 0)"""


def files(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return t.documents.select(
        F.concat(F.lit("d/"), k.cast("string")).alias("path"), F.when(k % 17 == 0, 0).otherwise(F.length("text")).alias("size"),
        F.sha2("text", 256).alias("sha256"), (k % 19 == 0).alias("all_nul"), F.lit(False).alias("nul_tail"),
    )


def file_ledger(t: Tables) -> DataFrame:
    k, n = F.col("doc_id"), F.length("text")
    path = F.concat(F.lit("d/"), k.cast("string")).alias("path")
    at = F.timestamp_seconds(k)
    a = t.documents.where(k % 3 != 0).select(
        path, n.alias("size"), F.sha2(F.when(k % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"), at.alias("retrieved_at")
    )
    b = t.documents.where(k % 2 == 0).select(
        path, F.when(k % 11 == 0, n).otherwise(n + 1).alias("size"), F.sha2("text", 256).alias("sha256"), at.alias("retrieved_at")
    )
    return a.unionByName(b)


@query(
    "classify_files",
    f"""{SQL_FILES}, v AS (SELECT f.path, count(l.path) AS n, bool_or(l.size = f.size AND l.sha = f.sha) AS ok, bool_or(l.size = f.size) AS sz FROM files f LEFT JOIN led l ON f.path = l.path GROUP BY 1)
    SELECT f.path, CASE WHEN n = 0 AND (f.size = 0 OR nul) THEN 'suspect' WHEN n = 0 THEN 'no_ledger' WHEN ok AND f.size = 0 THEN 'empty_upstream' WHEN ok THEN 'ok'
      WHEN f.size = 0 THEN 'empty' WHEN NOT sz THEN 'size_mismatch' ELSE 'sha256_mismatch' END AS status FROM files f JOIN v ON f.path = v.path""",
)
def classify_files(t: Tables) -> DataFrame:
    return archive.classify_files(files(t), file_ledger(t)).select("path", "status")


@query(
    "ledger_files_missing",
    f"""{SQL_FILES} SELECT DISTINCT path FROM led WHERE path NOT IN (SELECT path FROM files WHERE doc_id % 4 <> 0)""",
)
def ledger_files_missing(t: Tables) -> DataFrame:
    here = t.documents.where("doc_id % 4 <> 0").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    return archive.missing_files(file_ledger(t).withColumn("status", F.lit("verified")), here)


@query(
    "disk_check",
    """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 5 = 0)
    SELECT (SELECT count(*) FROM b) AS on_disk, (SELECT count(*) FROM a) AS ledger, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS missing_files,
      (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS unledgered_files""",
)
def disk_check(t: Tables) -> DataFrame:
    e = t.events
    return archive.disk_check(e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0"), ["user_id", "event_type"])


SQL_COPIES = """
WITH f AS (SELECT 'd/' || doc_id AS path, n_chars AS size, md5(text) AS md5 FROM documents WHERE doc_id % 5 <> 1),
r AS (SELECT 'd/' || doc_id AS path, n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'z' ELSE md5(text) END AS md5
  FROM documents WHERE doc_id % 4 <> 1)"""


@query(
    "compare_copies",
    f"""{SQL_COPIES} SELECT coalesce(f.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'absent' WHEN f.path IS NULL THEN 'remote_only'
      WHEN f.size <> r.size OR (r.md5 <> '' AND r.md5 <> f.md5) THEN 'differs' WHEN r.md5 = '' THEN 'same_size' ELSE 'same' END AS remote FROM f FULL JOIN r ON f.path = r.path""",
)
def compare_copies(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    path = F.concat(F.lit("d/"), k.cast("string")).alias("path")
    local = t.documents.where(k % 5 != 1).select(path, F.lit("ok").alias("status"), F.col("n_chars").alias("size"), F.md5("text").alias("md5"))
    md5 = F.when(k % 3 == 0, "").when(k % 7 == 0, "z").otherwise(F.md5("text"))
    there = t.documents.where(k % 4 != 1).select(path, (F.col("n_chars") + F.when(k % 13 == 0, 1).otherwise(0)).alias("size"), md5.alias("md5"))
    return archive.compare_copies(local, there).select("path", "remote")


@query(
    "repair_actions",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, ['ok', 'no_ledger', 'size_mismatch', 'empty_upstream'][(l_suppkey % 4)::INT + 1] AS ls,
        ['ok', 'ok', 'no_ledger', 'empty'][(l_partkey % 4)::INT + 1] AS rs, 'a' || l_linenumber AS lh, 'a' || l_quantity::INT % 7 AS rh, CASE WHEN l_tax > 0.04 THEN '' ELSE 'a' || l_quantity::INT % 5 END AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN ls = 'no_ledger' OR rs = 'no_ledger' THEN 'unknown'
      WHEN ls IN ('ok', 'empty_upstream') AND rs IN ('ok', 'empty_upstream') THEN CASE WHEN lh = rh THEN 'none' WHEN h <> '' AND lh = h THEN 'push' WHEN h <> '' AND rh = h THEN 'pull' ELSE 'choose' END
      WHEN ls IN ('ok', 'empty_upstream') THEN 'push' WHEN rs IN ('ok', 'empty_upstream') THEN 'pull' ELSE 'refetch' END AS action FROM s""",
)
def repair_actions(t: Tables) -> DataFrame:
    def pick(names: str, i):
        return F.element_at(F.array(*[F.lit(n) for n in names.split()]), (i + 1).cast("int"))

    def tag(i):
        return F.concat(F.lit("a"), i.cast("string"))

    q = F.col("l_quantity").cast("int")
    action = archive.repair_action(
        pick("ok no_ledger size_mismatch empty_upstream", F.col("l_suppkey") % 4), tag(F.col("l_linenumber")),
        pick("ok ok no_ledger empty", F.col("l_partkey") % 4), tag(q % 7), F.when(F.col("l_tax") > 0.04, "").otherwise(tag(q % 5)),
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", action.alias("action"))


SQL_COVER = """
WITH h AS (SELECT u.user_id AS station_id, g.h AS hour FROM (SELECT user_id, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events GROUP BY 1) u,
    unnest(generate_series(a, b, INTERVAL 1 HOUR)) g(h)),
i AS (SELECT user_id AS station_id, date_trunc('hour', ts) AS hour, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1, 2),
x AS (SELECT DISTINCT user_id AS station_id, date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'error'),
c AS (SELECT h.station_id, h.hour, CASE WHEN i.t IS NOT NULL THEN CAST(least(minute(i.t) // 10, 5) AS VARCHAR) WHEN x.hour IS NOT NULL THEN 'x'
    WHEN h.hour + INTERVAL 50 MINUTES <= TIMESTAMP '2024-01-25 12:00:00' THEN '?' ELSE '.' END AS code
  FROM h LEFT JOIN i ON h.station_id = i.station_id AND h.hour = i.hour LEFT JOIN x ON h.station_id = x.station_id AND h.hour = x.hour)"""


def codes(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("station_id"), F.col("ts").alias("time_utc"), "event_type")
    spans = e.groupBy("station_id").agg(F.min("time_utc").alias("a"), F.max("time_utc").alias("b"))
    cal = archive.hourly_calendar(spans, F.col("a"), F.col("b")).select("station_id", "hour")
    as_of = F.lit("2024-01-25 12:00:00").cast("timestamp")
    return archive.coverage_codes(cal, e.where("event_type = 'view'"), e.where("event_type = 'error'"), as_of)


@query("coverage_codes", f"{SQL_COVER} SELECT station_id, code, count(*) AS n FROM c GROUP BY 1, 2")
def coverage_codes(t: Tables) -> DataFrame:
    return codes(t).groupBy("station_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "coverage_strings",
    f"{SQL_COVER} SELECT station_id, strftime(hour, '%Y-%m-%d') AS day, string_agg(code, '' ORDER BY hour) AS coverage FROM c GROUP BY 1, 2",
)
def coverage_strings(t: Tables) -> DataFrame:
    return archive.coverage_strings(codes(t)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


SQL_LIGHT = f"""{SQL_COVER}, z AS (SELECT station_id, hour, epoch_us(hour) + 600000000 AS us, (station_id * 7) % 120 - 60.0::DOUBLE AS lat, (station_id * 13) % 360 - 180.0::DOUBLE AS lon FROM c), {sun_ctes('z')}"""


@query("illumination_of_hours", f"{SQL_LIGHT} SELECT station_id, epoch_us(hour) AS hour_us, {light_sql('elevation')} AS light FROM sun")
def illumination_of_hours(t: Tables) -> DataFrame:
    """The light category of every hour of the calendar, at minute 10."""
    lat, lon = (F.col("station_id") * 7) % 120 - 60.0, (F.col("station_id") * 13) % 360 - 180.0
    e, _ = geo.solar_position(F.col("hour") + F.expr("INTERVAL 10 MINUTES"), lat, lon)
    return codes(t).select("station_id", F.unix_micros(F.col("hour").cast("timestamp")).alias("hour_us"), geo.illumination(e).alias("light"))


@query("illumination_codes", f"{SQL_LIGHT} SELECT station_id, {light_sql('elevation')} AS light, count(*) AS n FROM sun GROUP BY 1, 2")
def illumination_codes(t: Tables) -> DataFrame:
    """Light category of each station hour at minute 10, counted per station."""
    c = codes(t)
    lat, lon = (F.col("station_id") * 7) % 120 - 60.0, (F.col("station_id") * 13) % 360 - 180.0
    e, _ = geo.solar_position(F.col("hour") + F.expr("INTERVAL 10 MINUTES"), lat, lon)
    return c.groupBy("station_id", geo.illumination(e).alias("light")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "daily_counts_zero_filled",
    """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM c GROUP BY 1)
    SELECT g.user_id, strftime(g.d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.d = c.d""",
)
def daily_counts_zero_filled(t: Tables) -> DataFrame:
    out = archive.daily_counts(t.events.where("event_type = 'view'"), "user_id", "ts")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "collection_rollup",
    """WITH l AS (SELECT event_type AS part, ts, event_id, CASE event_id % 7 WHEN 0 THEN 'not_found' WHEN 1 THEN 'failed' ELSE 'verified' END AS status FROM events)
    SELECT part, count(*) FILTER (status = 'verified') AS "count", CAST(coalesce(sum(event_id) FILTER (status = 'verified'), 0) AS BIGINT) AS bytes,
      epoch_us(min(ts) FILTER (status = 'verified')) AS first_us, epoch_us(max(ts) FILTER (status = 'verified')) AS last_us, count(*) FILTER (status = 'not_found') AS not_found,
      count(*) FILTER (status = 'failed') AS failed FROM l GROUP BY GROUPING SETS ((part), ())""",
)
def collection_rollup(t: Tables) -> DataFrame:
    k = F.col("event_id") % 7
    l = t.events.select(
        F.col("event_type").alias("part"), F.col("ts").cast("timestamp").alias("time_utc"), F.col("event_id").alias("size_bytes"),
        F.when(k == 0, "not_found").when(k == 1, "failed").otherwise("verified").alias("status"),
    )
    out = archive.rollup(l, "part")
    return out.withColumns({"first_us": F.unix_micros("first_utc"), "last_us": F.unix_micros("last_utc")}).drop("first_utc", "last_utc")


@query("ledger_run_summary", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def ledger_run_summary(t: Tables) -> DataFrame:
    return archive.run_summary(t.orders.select(F.col("o_orderstatus").alias("status")))


@query(
    "collector_runs",
    """WITH s AS (SELECT event_id AS run, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'),
    a AS (SELECT user_id, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'verified' WHEN 'click' THEN 'not_found' ELSE 'failed' END AS st, event_id FROM events WHERE event_type <> 'signup'),
    m AS (SELECT a.*, s.run, row_number() OVER (PARTITION BY a.event_id ORDER BY s.us DESC, s.run DESC) AS k FROM a JOIN s ON a.user_id = s.user_id AND s.us <= a.us),
    g AS (SELECT run, count(*) FILTER (st = 'verified') AS v, count(*) FILTER (st = 'not_found') AS n, count(*) FILTER (st = 'failed') AS f, max(us) AS l FROM m WHERE k = 1 GROUP BY 1)
    SELECT s.user_id, s.run, coalesce(v, 0) AS new_images, coalesce(n, 0) AS not_found, coalesce(f, 0) AS failed, CAST(coalesce(round((l - us) / 1e6), 0) AS BIGINT) AS duration_s
    FROM s LEFT JOIN g ON s.run = g.run""",
)
def collector_runs(t: Tables) -> DataFrame:
    e = t.events
    starts = e.where("event_type = 'signup'").select("user_id", F.col("event_id").cast("string").alias("run"), F.col("ts").alias("started"))
    status = F.when(F.col("event_type") == "view", "verified").when(F.col("event_type") == "click", "not_found").otherwise("failed")
    tries = e.where("event_type <> 'signup'").select("user_id", F.col("ts").alias("at"), status.alias("status"), "event_id")
    out = archive.collector_runs(starts, tries, ["user_id"], run="run")
    return out.drop("started").withColumn("run", F.col("run").cast("bigint"))


@query(
    "backfill_candidates",
    """WITH h AS (SELECT u.user_id, g.h AS hour FROM (SELECT user_id, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events GROUP BY 1) u, unnest(generate_series(a, b, INTERVAL 1 HOUR)) g(h))
    SELECT user_id, count(*) AS n FROM h, (VALUES (10), (20), (40)) m(minute) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = h.user_id AND date_trunc('hour', e.ts) = h.hour) GROUP BY 1""",
)
def backfill_candidates(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("ts").alias("time_utc"))
    spans = e.groupBy("user_id").agg(F.min("time_utc").alias("a"), F.max("time_utc").alias("b"))
    cal = archive.hourly_calendar(spans, F.col("a"), F.col("b"))
    return archive.backfill_candidates(cal, e, "user_id", [10, 20, 40]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_days",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS stations, count(*) AS files, CAST(sum(event_id) AS BIGINT) AS bytes FROM events GROUP BY 1""",
)
def snapshot_days(t: Tables) -> DataFrame:
    s = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("station_id"), F.col("event_id").alias("size_bytes"))
    return archive.snapshot_days(s, "day")


@query(
    "stream_freshness",
    f"""WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS l FROM events GROUP BY 1), a AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(l)) / 3.6e9 AS age FROM s)
    SELECT user_id, {sql_r6('age')} AS age_h, coalesce(age <= 48, FALSE) AS ok, {sql_r6('72 - age')} AS hours_to_loss FROM a""",
)
def stream_freshness(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("l"))
    out = archive.freshness(s, "user_id", "l", F.lit("2024-01-31").cast("timestamp"), "48h", "72h")
    return rounded(out, "age_h", "hours_to_loss")


def hourly(t: Tables) -> DataFrame:
    """Six-hourly mean values per supplier-sized station group, for the pair comparison."""
    six = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (6 * HOUR)) * HOUR)
    return t.events.groupBy((F.col("user_id") % 6).alias("s"), six.alias("h")).agg(F.avg("value").alias("v"))


@query(
    "pair_agreement",
    f"""WITH h AS (SELECT user_id % 6 AS s, CAST(floor(epoch_us(ts) / (6 * 3600000000.0::DOUBLE)) AS BIGINT) AS h, avg(value) AS v FROM events GROUP BY 1, 2),
    b AS (SELECT x.s AS a, y.s AS b, x.v AS x, y.v AS y, abs(x.v - y.v) / ((x.v + y.v) / 2) AS rel, ln(y.v / x.v) AS lr FROM h x JOIN h y ON x.h = y.h AND x.s < y.s),
    m AS (SELECT a, b, quantile_cont(lr, 0.5) AS med FROM b GROUP BY 1, 2),
    d AS (SELECT b.a, b.b, quantile_cont(abs(lr - med), 0.5) AS mad FROM b JOIN m ON b.a = m.a AND b.b = m.b GROUP BY 1, 2),
    l AS (SELECT x.s AS a, y.s AS b, k.k AS lag, corr(x.v, y.v) AS r FROM h x JOIN h y ON x.s < y.s, range(-3, 4) k(k) WHERE x.h - k.k = y.h GROUP BY 1, 2, 3)
    SELECT b.a, b.b, count(*) AS n_hours, {sql_r6('corr(x, y)')} AS pearson_r, {sql_r6('quantile_cont(rel, 0.5)')} AS median_abs_rel_diff, {sql_r6('quantile_cont(rel, 0.9)')} AS p90_abs_rel_diff,
      {sql_r6('100 * abs(exp(any_value(med)) - 1)')} AS systematic_pct, {sql_r6('100 * (exp(1.4826 * any_value(mad)) - 1)')} AS random_pct,
      CAST((SELECT arg_min(lag, (-r, lag)) FROM l WHERE l.a = b.a AND l.b = b.b) AS INT) AS best_lag_h, {sql_r6('(SELECT max(r) FROM l WHERE l.a = b.a AND l.b = b.b)')} AS r_best_lag
    FROM b JOIN m ON b.a = m.a AND b.b = m.b JOIN d ON b.a = d.a AND b.b = d.b GROUP BY b.a, b.b HAVING count(*) >= 50""",
)
def pair_agreement(t: Tables) -> DataFrame:
    h = hourly(t)
    s = h.select("s").distinct()
    pairs = s.select(F.col("s").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    pairs = pairs.select("a", F.col("k").cast("bigint").alias("b")).where("a < b")
    out = archive.pair_agreement(h, pairs, station="s", hour="h", value="v", min_hours=50)
    return rounded(out, "pearson_r", "median_abs_rel_diff", "p90_abs_rel_diff", "systematic_pct", "random_pct", "r_best_lag")


@query(
    "samples_from_long_records",
    """WITH l AS (SELECT user_id, date_trunc('day', ts) AS d, event_type, arg_min(value, event_id) AS v FROM events GROUP BY 1, 2, 3)
    SELECT user_id, epoch_us(d) AS us, max(v) FILTER (event_type = 'view') AS view, max(v) FILTER (event_type = 'click') AS click FROM l WHERE event_type IN ('view', 'click', 'error', 'signup', 'purchase') GROUP BY 1, 2""",
)
def samples_from_long_records(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")).alias("us"), "event_type", "value", "event_id")
    return archive.samples_from_long(e, ["user_id", "us"], "event_type", "value", ["view", "click"], "event_id")


@query(
    "record_spacing",
    f"""WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS g FROM events),
    m AS (SELECT user_id, quantile_cont(g, 0.5) AS m FROM g WHERE g IS NOT NULL GROUP BY 1)
    SELECT g.user_id, {sql_r6('any_value(m)')} AS median_gap_s, {sql_r6('max(g)')} AS max_gap_s, count(*) FILTER (g > 1.5 * m) AS n_gaps FROM g JOIN m ON g.user_id = m.user_id GROUP BY 1""",
)
def record_spacing(t: Tables) -> DataFrame:
    return rounded(archive.spacing_summary(t.events, ["user_id"], "ts", "event_id"), "median_gap_s", "max_gap_s")


@query(
    "within_group_spearman",
    f"""WITH r AS (SELECT (rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY l_suppkey) AS a,
      (rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY l_suppkey) AS b FROM lineitem)
    SELECT {sql_r6('corr(a, b)')} AS rho, count(*) AS n FROM r""",
)
def within_group_spearman(t: Tables) -> DataFrame:
    return rounded(archive.within_group_spearman(t.lineitem, "l_suppkey", "l_quantity", "l_extendedprice"), "rho")


@query(
    "partition_energy",
    f"""WITH d AS (SELECT l_returnflag, l_quantity - sqrt(power(l_quantity * 0.8, 2) + power(l_tax * 100, 2)) AS d FROM lineitem)
    SELECT l_returnflag, {sql_r6('quantile_cont(d, 0.05)')} AS p05, {sql_r6('quantile_cont(d, 0.5)')} AS median, {sql_r6('quantile_cont(d, 0.95)')} AS p95, count(*) AS n,
      {sql_r6('avg(CASE WHEN abs(d) <= 2.5 THEN 1.0 ELSE 0 END)')} AS share_within FROM d GROUP BY 1""",
)
def partition_energy(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("h"), (F.col("l_quantity") * 0.8).alias("s"), (F.col("l_tax") * 100).alias("w"))
    return rounded(archive.partition_energy(d, ["l_returnflag"], "h", "s", "w", 2.5), "p05", "median", "p95", "share_within")


@query("station_payload")
def station_payload(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("hs"), F.max("value").alias("gust"))
    return archive.station_payload(s, "user_id", "t", {"hs": 2, "gust": 1})
