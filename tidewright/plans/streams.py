"""Queries that run a stream over the event files to its end and read the sink back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table
from ..streaming import jobs, timers
from .registry import Tables, query, r6, sql_r6


def _scratch(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def event_stream(t: Tables) -> DataFrame:
    schema = table(t.spark, t.folder, "events").schema
    s = jobs.open_table(t.spark, t.folder, "events.parquet", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _sink(t: Tables, stream: DataFrame) -> DataFrame:
    base = _scratch(t)
    jobs.run_to_parquet(stream, f"{base}/out", f"{base}/state")
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(
    "stream_hourly_counts",
    """SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n, epoch_us(min(ts)) AS first_us FROM events
    GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 72 HOURS""",
)
def stream_hourly_counts(t: Tables) -> DataFrame:
    out = _sink(t, jobs.hourly_counts(event_stream(t), "ts", ["event_type"]))
    return out.select("event_type", F.unix_micros("hour").alias("hour_us"), "n", F.unix_micros("first_utc").alias("first_us"))


@query("stream_deduplicated", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_deduplicated(t: Tables) -> DataFrame:
    twice = event_stream(t).unionByName(event_stream(t))
    out = _sink(t, jobs.first_of_key(twice, "ts", ["event_id"]).select("event_id", "event_type"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "stream_run_sessions",
    """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k
    HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 72 HOURS""",
)
def stream_run_sessions(t: Tables) -> DataFrame:
    out = _sink(t, jobs.run_sessions(event_stream(t), "ts", ["user_id"], "6 hours"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(
    "stream_label_join",
    """SELECT a.event_id, b.event_id AS ref_id, b.value FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'
      AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000""",
)
def stream_label_join(t: Tables) -> DataFrame:
    s = event_stream(t)
    a = s.where("event_type = 'click'").select("event_id", "user_id", "ts")
    b = event_stream(t).where("event_type = 'view'").select(F.col("event_id").alias("ref_id"), "user_id", F.col("ts").alias("rts"), "value")
    return _sink(t, jobs.interval_join(a, b, ["user_id"], "ts", "rts").select("event_id", "ref_id", "value"))


@query(
    "stream_latest_state",
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1
    HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 8 DAYS""",
)
def stream_latest_state(t: Tables) -> DataFrame:
    base = _scratch(t)
    log = jobs.ChangeLog(f"{base}/log", ["user_id"], ["ts", "event_id"], "ts", "8d")
    jobs.run_batches(event_stream(t), log.write, f"{base}/state")
    return log.read(t.spark).select("user_id", "event_id", "value")


@query(
    "stream_trailing_quality",
    """WITH s AS (SELECT event_id, value AS v, count(value) OVER w AS n, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
    SELECT event_id, CAST(CASE WHEN n >= 6 AND abs(v - mu) > 2 * sd THEN 3 ELSE 1 END AS TINYINT) AS mean_std_flag FROM s""",
)
def stream_trailing_quality(t: Tables) -> DataFrame:
    base = _scratch(t)
    each = jobs.trailing_quality(f"{base}/h", ["user_id"], "ts", "value", "5d", 2.0)
    jobs.run_batches(event_stream(t), each, f"{base}/state")
    return t.spark.read.parquet(f"{base}/h/flags").select("event_id", "mean_std_flag")


@query(
    "stream_merged_snapshots",
    f"""SELECT user_id, epoch_us(date_trunc('day', ts)) AS us, {sql_r6('arg_max(value, event_id)')} AS hs, count(*) AS n_snapshots, max(value) - min(value) > 0.05 AS snapshots_disagree
    FROM events GROUP BY 1, 2""",
)
def stream_merged_snapshots(t: Tables) -> DataFrame:
    """Snapshot rows are logged as they come and merged when read."""
    from ..sources.stations import merge_snapshots

    base = _scratch(t)
    rows = event_stream(t).select(
        "user_id", F.unix_micros(F.date_trunc("day", "ts")).alias("us"), F.col("event_id").alias("snapshot"), F.col("value").alias("hs")
    )
    jobs.run_to_parquet(rows, f"{base}/out", f"{base}/state")
    log = t.spark.read.schema(rows.schema).parquet(f"{base}/out")
    return merge_snapshots(log, ["user_id", "us"], ["hs"], "hs").select("user_id", "us", r6("hs").alias("hs"), "n_snapshots", "snapshots_disagree")


def _timed(t: Tables, stream: DataFrame) -> DataFrame:
    with timers.keyed_state(t.spark):
        return _sink(t, stream)


@query(
    "stream_coverage_codes",
    """WITH a AS (SELECT date_trunc('millisecond', max(ts)) AS as_of FROM events),
    h AS (SELECT user_id, date_trunc('hour', ts) AS hour, min(ts) FILTER (event_type <> 'error') AS t FROM events GROUP BY 1, 2),
    c AS (SELECT user_id, unnest(generate_series(min(hour), date_trunc('hour', (SELECT as_of FROM a)), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY 1)
    SELECT CAST(c.user_id AS VARCHAR) AS key, epoch_us(c.hour) AS hour_us, CASE WHEN h.t IS NOT NULL THEN CAST(minute(h.t) // 10 AS VARCHAR) WHEN h.user_id IS NOT NULL THEN 'x'
      WHEN c.hour + INTERVAL 50 MINUTES <= as_of THEN '?' ELSE '.' END AS code
    FROM c CROSS JOIN a LEFT JOIN h ON h.user_id = c.user_id AND h.hour = c.hour""",
)
def stream_coverage_codes(t: Tables) -> DataFrame:
    """Every user is a station, an error an hour that wasn't published; gaps are found by timers."""
    kind = F.when(F.col("event_type") == "error", "not_found").otherwise("image")
    changes = _timed(t, timers.coverage_changes(event_stream(t), "user_id", "ts", kind))
    as_of = t.events.agg(F.max("ts").cast("timestamp").alias("as_of")).first()["as_of"]
    return timers.coverage_now(changes, F.lit(as_of))


@query(
    "stream_freshness_alerts",
    """WITH a AS (SELECT epoch_us(date_trunc('millisecond', max(ts))) - 3600000000 AS now FROM events),
    e AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, now FROM events CROSS JOIN a WHERE epoch_us(ts) <= now)
    SELECT CAST(user_id AS VARCHAR) AS key, us AS last_us, us + 86400000000 AS alert_us, us + 71 * 3600000000 AS lost_us, nxt AS back_us
    FROM e WHERE nxt - us > 86400000000 OR nxt IS NULL AND now - us >= 86400000000""",
)
def stream_freshness_alerts(t: Tables) -> DataFrame:
    """Users silent for more than a day, as known an hour after the fact."""
    changes = _timed(t, timers.silence_changes(event_stream(t), "user_id", "ts", "24h"))
    return timers.alerts(changes, "24h", timers.BACKFILL)
