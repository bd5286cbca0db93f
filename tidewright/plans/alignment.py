"""Queries of the alignment operators: clicks are targets, views are reference records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import micros
from ..operators import align
from .registry import Tables, query, r6, rounded, sql_r6

SQL_SIDES = """
WITH t AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
r AS (SELECT event_id AS ref_id, user_id, epoch_us(ts) AS us, value, value * 0.9 AS angle
      FROM events WHERE event_type = 'view')"""


def clicks(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")


def views(t: Tables) -> DataFrame:
    half = F.expr("INTERVAL 10 MINUTES")
    return t.events.where("event_type = 'view'").select(
        F.col("event_id").alias("ref_id"),
        "user_id",
        F.col("ts").alias("rts"),
        (F.col("ts") - half).alias("start_utc"),
        (F.col("ts") + half).alias("end_utc"),
        "value",
        (F.col("value") * 0.9).alias("angle"),
    )


def _asof(direction: str, condition: str, order: str) -> None:
    sql = f"""{SQL_SIDES}
    , m AS (SELECT t.event_id, r.ref_id, r.value, (t.us - r.us) / 1e6 AS off,
              row_number() OVER (PARTITION BY t.event_id ORDER BY {order}) AS k
            FROM t JOIN r ON t.user_id = r.user_id AND abs(t.us - r.us) <= 21600000000 AND {condition})
    SELECT t.event_id, t.user_id, m.ref_id AS ref_id_ref, m.value AS value_ref, m.off AS time_offset_s,
      CAST(CASE WHEN m.off IS NULL THEN 9 WHEN abs(m.off) > 3600 THEN 3 ELSE 1 END AS TINYINT) AS sync_qc_flag
    FROM t LEFT JOIN m ON t.event_id = m.event_id AND m.k = 1"""

    @query(f"asof_{direction}", sql)
    def run(t: Tables) -> DataFrame:
        out = align.pair_nearest(
            clicks(t), views(t), tolerance="6h", by=["user_id"], target_time="ts", reference_time="rts",
            direction=direction, suspect_offset="1h", values=["ref_id", "value"], reference_tie="ref_id",
        )
        return out.select("event_id", "user_id", "ref_id_ref", "value_ref", "time_offset_s", "sync_qc_flag")


_asof("nearest", "TRUE", "abs(t.us - r.us), r.us, r.ref_id DESC")
_asof("backward", "r.us <= t.us", "r.us DESC, r.ref_id DESC")
_asof("forward", "r.us >= t.us", "r.us, r.ref_id")

SQL_PAIRS = f"""{SQL_SIDES}
, p AS (SELECT t.event_id, t.user_id, r.ref_id, (t.us - r.us) / 1e6 AS offset_s, r.value, r.angle,
          (t.us >= r.us - 600000000 AND t.us < r.us + 600000000) AS in_record,
          abs(t.us - r.us) AS a, r.us AS c
        FROM t JOIN r ON t.user_id = r.user_id AND abs(t.us - r.us) <= 21600000000)"""


def pairs(t: Tables, rank: bool = False) -> DataFrame:
    return align.pair_window(
        clicks(t), views(t), window="6h", by=["user_id"], target_id="event_id", reference_id="ref_id",
        target_time="ts", values=["value", "angle"], rank=rank,
    )


@query(
    "window_pairs",
    f"""{SQL_PAIRS} SELECT event_id, user_id, ref_id, offset_s, in_record,
      row_number() OVER (PARTITION BY event_id ORDER BY a, c, ref_id) - 1 AS rank FROM p""",
)
def window_pairs(t: Tables) -> DataFrame:
    return pairs(t, rank=True).drop("value", "angle")


@query(
    "nearest_record_of_target",
    f"""{SQL_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY a, c, ref_id) - 1 AS rank
      FROM p) SELECT event_id, ref_id, offset_s FROM k WHERE rank = 0""",
)
def nearest_record_of_target(t: Tables) -> DataFrame:
    return pairs(t, rank=True).where("rank = 0").select("event_id", "ref_id", "offset_s")


@query(
    "overlap_pairs",
    f"""{SQL_SIDES}, o AS (SELECT t.event_id, r.ref_id,
        (least(t.us + 1800000000, r.us + 7200000000) - greatest(t.us - 1800000000, r.us - 7200000000)) / 1e6 AS s,
        (t.us - r.us) / 1e6 AS d FROM t JOIN r ON t.user_id = r.user_id)
    SELECT event_id, ref_id, s AS overlap_s, {sql_r6('s / 3600.0')} AS overlap_fraction, d AS center_offset_s
    FROM o WHERE s / 3600.0 >= 0.5""",
)
def overlap_pairs(t: Tables) -> DataFrame:
    def span(df: DataFrame, time: str, key: str, text: str) -> DataFrame:
        half = F.expr(f"INTERVAL {text}")
        return df.select(key, "user_id", (F.col(time) - half).alias("s"), (F.col(time) + half).alias("e"))

    out = align.pair_overlap(
        span(clicks(t), "ts", "event_id", "30 MINUTES"), span(views(t), "rts", "ref_id", "2 HOURS"),
        bucket="4h", by=["user_id"], target_id="event_id", reference_id="ref_id",
        target_span=("s", "e"), reference_span=("s", "e"), min_fraction=0.5,
    )
    return rounded(out, "overlap_fraction").drop("user_id")


def _label(name: str, rule: str, sql: str, value: str = "value", **kw) -> None:
    @query(name, sql)
    def run(t: Tables) -> DataFrame:
        out = align.label_candidates(
            pairs(t), value, rule=rule, target="event_id", reference="ref_id", max_offset="3h",
            max_gap="8h", **kw,
        )
        return rounded(out, "label", "spread", "max_abs_offset_s")


def _nearest_sql(where: str, off: str = "offset_s") -> str:
    return f"""{SQL_PAIRS}, q AS (SELECT *, {off} AS o FROM p),
    k AS (SELECT event_id, value, o, row_number() OVER (PARTITION BY event_id ORDER BY abs(o), o DESC, ref_id) AS n
          FROM q WHERE {where})
    SELECT d.event_id, {sql_r6('k.value')} AS label, CAST(NULL AS DOUBLE) AS spread,
      CAST(CASE WHEN k.event_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_records,
      {sql_r6('abs(k.o)')} AS max_abs_offset_s
    FROM (SELECT DISTINCT event_id FROM p) d LEFT JOIN k ON d.event_id = k.event_id AND k.n = 1"""


_label("label_nearest", "nearest", _nearest_sql("abs(o) <= 10800"))
_label("label_nearest_lagged", "nearest", _nearest_sql("abs(o) <= 10800", "offset_s - 1800.0"), lag_s=1800.0)
_label("label_in_record", "in_record", _nearest_sql("in_record"))
_label(
    "label_window_mean",
    "window_mean",
    f"""{SQL_PAIRS} SELECT event_id, {sql_r6('avg(value) FILTER (abs(offset_s) <= 10800)')} AS label,
      CASE WHEN count(*) FILTER (abs(offset_s) <= 10800) >= 2 THEN
        {sql_r6('max(value) FILTER (abs(offset_s) <= 10800) - min(value) FILTER (abs(offset_s) <= 10800)')} END
        AS spread,
      count(*) FILTER (abs(offset_s) <= 10800) AS n_records,
      {sql_r6('max(abs(offset_s)) FILTER (abs(offset_s) <= 10800)')} AS max_abs_offset_s
    FROM p GROUP BY event_id""",
)
_label(
    "label_window_mean_circular",
    "window_mean",
    f"""{SQL_PAIRS}, m AS (SELECT event_id, count(*) AS n, max(abs(offset_s)) AS far,
        degrees(atan2(avg(sin(radians(angle))), avg(cos(radians(angle))))) AS d
      FROM p WHERE abs(offset_s) <= 10800 GROUP BY event_id),
    c AS (SELECT event_id, n, far, CASE WHEN d < 0 THEN d + 360 ELSE d END AS label FROM m),
    e AS (SELECT p.event_id, angle - label + 180 AS x FROM p JOIN c ON p.event_id = c.event_id
          WHERE abs(offset_s) <= 10800),
    s AS (SELECT event_id, max(x - 360 * floor(x / 360)) - min(x - 360 * floor(x / 360)) AS spread
          FROM e GROUP BY event_id)
    SELECT q.event_id, {sql_r6('c.label')} AS label,
      CASE WHEN c.n >= 2 THEN {sql_r6('s.spread')} END AS spread, coalesce(c.n, 0) AS n_records,
      {sql_r6('c.far')} AS max_abs_offset_s
    FROM (SELECT DISTINCT event_id FROM p) q LEFT JOIN c ON q.event_id = c.event_id
    LEFT JOIN s ON q.event_id = s.event_id""",
    value="angle",
    circular=True,
)
SQL_BRACKET = f"""{SQL_PAIRS},
b AS (SELECT event_id, arg_min(value, (offset_s, ref_id)) AS v, min(offset_s) AS o FROM p
      WHERE offset_s >= 0 GROUP BY event_id),
a AS (SELECT event_id, arg_max(value, (offset_s, -ref_id)) AS v, max(offset_s) AS o FROM p
      WHERE offset_s < 0 GROUP BY event_id),
j AS (SELECT q.event_id, b.v AS vb, b.o AS ob, a.v AS va, a.o AS oa, b.o - a.o AS span
      FROM (SELECT DISTINCT event_id FROM p) q LEFT JOIN b ON q.event_id = b.event_id
      LEFT JOIN a ON q.event_id = a.event_id)"""
_label(
    "label_interpolate",
    "interpolate",
    f"""{SQL_BRACKET} SELECT event_id,
      {sql_r6('CASE WHEN ob = 0 THEN vb WHEN span <= 28800 THEN vb + ob / span * (va - vb) END')} AS label,
      {sql_r6('CASE WHEN ob <> 0 AND span <= 28800 THEN abs(va - vb) END')} AS spread,
      CAST(CASE WHEN ob = 0 THEN 1 WHEN span <= 28800 THEN 2 ELSE 0 END AS BIGINT) AS n_records,
      {sql_r6('CASE WHEN ob = 0 THEN 0 WHEN span <= 28800 THEN greatest(ob, -oa) END')} AS max_abs_offset_s
    FROM j""",
)


@query(
    "point_in_interval",
    """WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
    s AS (SELECT event_id AS run, user_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'signup'),
    m AS (SELECT q.event_id, s.run, s.us AS start, row_number() OVER (PARTITION BY q.event_id
            ORDER BY s.us DESC, s.run DESC) AS k, q.us
          FROM q JOIN s ON q.user_id = s.user_id AND s.us <= q.us)
    SELECT q.event_id, CASE WHEN m.us < m.start + 43200000000 THEN m.run END AS run,
      CASE WHEN m.run IS NULL THEN 'no_interval' WHEN m.us < m.start + 43200000000 THEN 'matched'
           ELSE 'outside' END AS interval_status
    FROM q LEFT JOIN m ON q.event_id = m.event_id AND m.k = 1""",
)
def point_in_interval(t: Tables) -> DataFrame:
    runs = t.events.where("event_type = 'signup'").select(
        F.col("event_id").alias("run"), "user_id", F.col("ts").alias("s"),
        (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("e"),
    )
    points = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return align.point_in_interval(
        points, runs, by=["user_id"], time="ts", start="s", end="e", values=["run"], tie="run"
    ).select("event_id", "run", "interval_status")


def _interp_sql(expr: str) -> str:
    return f"""{SQL_SIDES},
    b AS (SELECT t.event_id, max(r.us) AS u FROM t JOIN r ON t.user_id = r.user_id AND r.us <= t.us GROUP BY 1),
    a AS (SELECT t.event_id, min(r.us) AS u FROM t JOIN r ON t.user_id = r.user_id AND r.us >= t.us GROUP BY 1),
    j AS (SELECT t.event_id, t.us, b.u AS u0, a.u AS u1, r0.value AS v0, r1.value AS v1,
            r0.angle AS a0, r1.angle AS a1, (t.us - b.u) / (a.u - b.u)::DOUBLE AS w
          FROM t LEFT JOIN b ON t.event_id = b.event_id LEFT JOIN a ON t.event_id = a.event_id
          LEFT JOIN r r0 ON r0.user_id = t.user_id AND r0.us = b.u
          LEFT JOIN r r1 ON r1.user_id = t.user_id AND r1.us = a.u)
    SELECT event_id, {sql_r6(expr)} AS interpolated FROM j"""


@query(
    "interpolate_series",
    _interp_sql("CASE WHEN us = u0 THEN v0 WHEN u1 - u0 <= 43200000000 THEN v0 + w * (v1 - v0) END"),
)
def interpolate_series(t: Tables) -> DataFrame:
    out = align.interpolate_at(
        clicks(t), views(t), value="value", max_gap="12h", by=["user_id"], target_time="ts", series_time="rts"
    )
    return rounded(out.select("event_id", "interpolated"), "interpolated")


_MIX = "{f}(radians(a0)) + w * ({f}(radians(a1)) - {f}(radians(a0)))"
_ATAN = f"degrees(atan2({_MIX.format(f='sin')}, {_MIX.format(f='cos')}))"


@query(
    "interpolate_directions",
    _interp_sql(
        f"CASE WHEN us = u0 THEN a0 WHEN u1 - u0 <= 43200000000 THEN "
        f"CASE WHEN {_ATAN} < 0 THEN {_ATAN} + 360 ELSE {_ATAN} END END"
    ),
)
def interpolate_directions(t: Tables) -> DataFrame:
    out = align.interpolate_at(
        clicks(t), views(t), value="angle", max_gap="12h", by=["user_id"], target_time="ts",
        series_time="rts", circular=True,
    )
    return rounded(out.select("event_id", "interpolated"), "interpolated")


@query(
    "persistence_forecast",
    f"""{SQL_SIDES}, m AS (SELECT t.event_id, r.value,
        row_number() OVER (PARTITION BY t.event_id ORDER BY r.us DESC, r.ref_id DESC) AS k
      FROM t JOIN r ON t.user_id = r.user_id AND r.us <= t.us - 3600000000
        AND t.us - 3600000000 - r.us <= 43200000000)
    SELECT t.event_id, m.value AS persistence FROM t LEFT JOIN m ON t.event_id = m.event_id AND m.k = 1""",
)
def persistence_forecast(t: Tables) -> DataFrame:
    out = align.pair_nearest(
        clicks(t), views(t), tolerance="12h", by=["user_id"], target_time="ts", reference_time="rts",
        direction="backward", values=["value"], reference_tie="ref_id", lag="1h",
    )
    return out.select("event_id", F.col("value_ref").alias("persistence"))


@query(
    "nearest_item_on_grid",
    """WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us FROM events),
    c AS (SELECT event_id, event_type, us, unnest(generate_series(
            CAST(ceil((us - 600000000) / 1800000000.0) AS BIGINT),
            CAST(floor((us + 600000000) / 1800000000.0) AS BIGINT))) * 1800000000 AS g FROM e),
    b AS (SELECT *, row_number() OVER (PARTITION BY event_type, g ORDER BY abs(us - g), us, event_id) AS k FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY g) AS n FROM b WHERE k = 1)
    SELECT event_type, event_id, g AS grid_us, (us - g) / 1e6 AS offset_s FROM f WHERE n = 1""",
)
def nearest_item_on_grid(t: Tables) -> DataFrame:
    return align.nearest_on_grid(
        t.events, time="ts", every="30min", tolerance="10min", item="event_id", by=["event_type"]
    )


@query(
    "forecast_match",
    """WITH f AS (SELECT user_id, epoch_us(date_trunc('hour', ts)) AS valid_us, avg(value) AS forecast
                FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    s AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click')
    SELECT s.event_id, CAST(floor(us / 21600000000) AS BIGINT) * 21600000000 AS issue_us,
      CAST(ceil(us / 3600000000.0 - 0.5) AS BIGINT) * 3600000000 AS valid_us,
      (round(f.forecast + 1e-10, 6) + 0.0) AS forecast, f.user_id IS NOT NULL AS has_forecast
    FROM s LEFT JOIN f ON s.user_id = f.user_id AND f.valid_us = CAST(ceil(us / 3600000000.0 - 0.5) AS BIGINT) * 3600000000""",
)
def forecast_match(t: Tables) -> DataFrame:
    """Issue time is the 6 h floor; valid time the nearest hour, a half hour going to the earlier."""
    hour = 3_600_000_000
    points = (
        t.events.where("event_type = 'view'")
        .groupBy("user_id", micros(F.date_trunc("hour", "ts")).alias("valid_us"))
        .agg(F.avg("value").alias("forecast"), F.lit(True).alias("_hit"))
    )
    us = micros("ts")
    strips = clicks(t).select(
        "event_id",
        "user_id",
        (F.floor(us / (6 * hour)) * (6 * hour)).alias("issue_us"),
        (F.ceil(us / hour - 0.5) * hour).alias("valid_us"),
    )
    return strips.join(points, ["user_id", "valid_us"], "left").select(
        "event_id", "issue_us", "valid_us", r6("forecast").alias("forecast"),
        F.coalesce("_hit", F.lit(False)).alias("has_forecast"),
    )
