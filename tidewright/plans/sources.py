"""Queries of the providers' quality suites: events stand for wave records, their values for heights."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import suites
from .registry import Tables, query

SERIES = ["user_id", "event_type"]
#: Events are days apart, so the carriers' spacing and windows are in days.
SPACING = {"expected_s": 86400.0, "max_change": 6.0}
SQL_WAVES = """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, ts, CASE WHEN value > 200 THEN NULL ELSE value / 10 END AS v,
    CASE WHEN user_id % 11 > 0 THEN 3.0 + user_id % 11 END AS p, CASE event_id % 6 WHEN 0 THEN '4/1' WHEN 1 THEN '3/0' WHEN 2 THEN 'x' ELSE '1/0' END AS f FROM events),
l AS (SELECT *, lag(us) OVER w AS pu, lag(v) OVER w AS pv FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
b AS (SELECT *, CASE WHEN abs(v - pv) <= {flat} THEN 0 ELSE 1 END AS brk FROM l),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS island FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY us, event_id) AS run,
  count(v) OVER m AS n, avg(v) OVER m AS mu, stddev_samp(v) OVER m AS sd, 2 * pi() * v / (9.80665 * p * p) AS s FROM i
  WINDOW m AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
t AS (SELECT event_id, CASE WHEN us - pu <= 0 THEN 4 WHEN us - pu > 86400e6 * 1.5 THEN 3 ELSE 1 END AS gap_flag,
  CASE WHEN v IS NULL THEN 9 WHEN abs(v - pv) > 6 THEN 4 ELSE 1 END AS rate_flag,
  CASE WHEN v IS NULL THEN 9 WHEN run >= 5 AND v <> 0 THEN 4 WHEN run >= 3 THEN 3 ELSE 1 END AS flat_flag,
  CASE WHEN v IS NULL THEN 9 WHEN n >= 6 AND abs(v - mu) > greatest(3 * sd, 1e-9 * greatest(abs(v), abs(mu))) THEN 3 ELSE 1 END AS mean_std_flag,
  CASE WHEN v IS NULL THEN 9 WHEN v < 0 OR v > 25 THEN 4 WHEN v < 0.05 OR v > 15 THEN 3 ELSE 1 END AS range_flag,
  CASE WHEN s IS NULL THEN 9 WHEN s > 0.142 THEN 4 WHEN s > 0.07 THEN 3 ELSE 1 END AS steepness_flag,
  CASE f WHEN '4/1' THEN 4 WHEN '3/0' THEN 3 WHEN '1/0' THEN 1 ELSE 2 END AS provider_flag FROM r)
"""
TESTS = {
    "ndbc": ["gap_flag", "rate_flag", "flat_flag", "mean_std_flag", "range_flag", "steepness_flag"],
    "cdip": ["gap_flag", "rate_flag", "flat_flag", "mean_std_flag", "range_flag", "steepness_flag", "provider_flag"],
    "era5": ["gap_flag", "rate_flag", "range_flag", "steepness_flag"],
    "wis": ["gap_flag", "rate_flag", "range_flag", "steepness_flag"],
}


def sql(source: str) -> str:
    """A missing flag is the largest; of not evaluated and pass, pass is the stronger one."""
    tests = TESTS[source]
    strong = "greatest(" + ", ".join(f"CASE {t} WHEN 2 THEN 0 ELSE {t} END" for t in tests) + ")"
    flags = ", ".join(f"CAST({t} AS TINYINT) AS {t}" for t in tests)
    return SQL_WAVES.format(flat=0.5) + f"SELECT event_id, {flags}, CAST(CASE {strong} WHEN 0 THEN 2 ELSE {strong} END AS TINYINT) AS qc_flag FROM t"


def waves(t: Tables) -> DataFrame:
    """Events as records: a height with missing values, a period by station, a provider's flag."""
    eleventh = F.col("user_id") % 11
    return t.events.select(
        "event_id", *SERIES, "ts", F.when(F.col("value") <= 200, F.col("value") / 10).alias("v"), F.when(eleventh > 0, 3.0 + eleventh).alias("p"),
        F.element_at(F.array(*map(F.lit, ["4/1", "3/0", "x", "1/0", "1/0", "1/0"])), (F.col("event_id") % 6 + 1).cast("int")).alias("f"),
    )


def run(t: Tables, source: str) -> DataFrame:
    suite = replace(suites.SUITES[source], **SPACING)
    if suite.mean_window is not None:
        suite = replace(suite, mean_window="10d", flat_tolerance=0.5)
    out, tests = suites.run(waves(t), suite, by=SERIES, time="ts", height="v", period="p", tie="event_id", source_flag="f")
    return out.select("event_id", *tests, "qc_flag")


@query("qc_suite_ndbc", sql("ndbc"))
def qc_suite_ndbc(t: Tables) -> DataFrame:
    return run(t, "ndbc")


@query("qc_suite_cdip", sql("cdip"))
def qc_suite_cdip(t: Tables) -> DataFrame:
    return run(t, "cdip")


@query("qc_suite_era5", sql("era5"))
def qc_suite_era5(t: Tables) -> DataFrame:
    return run(t, "era5")


@query("qc_suite_wis", sql("wis"))
def qc_suite_wis(t: Tables) -> DataFrame:
    return run(t, "wis")
