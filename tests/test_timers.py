"""Streams with timers: the same table as a batch, whatever the order of files, late rows and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.operators import archive
from tidewright.streaming import jobs, timers

START = datetime(2024, 3, 1)


def rows_of(seed):
    """Three stations (one with most rows) over four days with holes; times in minutes from the start."""
    rnd = random.Random(seed)
    rows = []
    for minute in range(0, 4 * 24 * 60, 7):
        for station, share in (("hot", 0.9), ("thin", 0.05), ("late", 0.2 if minute > 2000 else 0)):
            if rnd.random() < share and not (station == "hot" and 1500 < minute < 1900):
                rows.append((station, "image" if rnd.random() < 0.8 else "not_found", START + timedelta(minutes=minute, seconds=rnd.randint(0, 59))))
    return rows


def files(spark, folder, rows, n, late_minutes, seed):
    """The rows as ``n`` files, each row moved back by up to ``late_minutes`` in the order of arrival."""
    rnd = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rnd.uniform(0, late_minutes)))
    size = -(-len(arrival) // n)
    for k in range(n):
        part = spark.createDataFrame(arrival[k * size : (k + 1) * size], "station string, kind string, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return jobs.open_table(spark, folder, "*.parquet", spark.read.parquet(folder).schema, max_files=1)


def run(spark, frame, base):
    with timers.keyed_state(spark):
        jobs.run_to_parquet(frame, f"{base}/out", f"{base}/state")
    return spark.read.schema(frame.schema).parquet(f"{base}/out")


@pytest.mark.parametrize("late_minutes", [0, 600])
def test_coverage_equals_batch(spark, tmp_path, late_minutes):
    rows = rows_of(1)
    files(spark, str(tmp_path / "in"), rows, 4, late_minutes, 5)
    kind = F.col("kind")
    changes = run(spark, timers.coverage_changes(stream(spark, str(tmp_path / "in")), "station", "ts", kind, delay="12h"), tmp_path)
    table = spark.createDataFrame(rows, "station_id string, kind string, time_utc timestamp")
    as_of = F.lit(max(r[2] for r in rows))
    spans = table.groupBy("station_id").agg(F.min("time_utc").alias("a"))
    calendar = archive.hourly_calendar(spans, F.col("a"), as_of).select("station_id", "hour")
    want = archive.coverage_codes(calendar, table.where("kind = 'image'"), table.where("kind = 'not_found'"), as_of)
    want = {(r["station_id"], int(r["hour"].timestamp()) if r["hour"].tzinfo else r["hour"]): r["code"] for r in want.collect()}
    got = timers.coverage_now(changes, as_of).withColumn("hour", F.timestamp_micros("hour_us"))
    got = [(r["key"], r["hour"], r["code"]) for r in got.collect()]
    assert len(got) == len(want) and {(s, h): c for s, h, c in got} == want
    assert {c for *_, c in got} >= {"?", "x", "0", "5"}


def test_coverage_survives_a_restart_and_repeated_changes(spark, tmp_path):
    rows = rows_of(2)
    half = [r for r in rows if r[2] < START + timedelta(days=2)]
    files(spark, str(tmp_path / "in"), half, 2, 0, 1)
    make = lambda: timers.coverage_changes(stream(spark, str(tmp_path / "in")), "station", "ts", F.col("kind"), delay="12h")
    run(spark, make(), tmp_path)
    files(spark, str(tmp_path / "in"), [r for r in rows if r not in half], 2, 0, 1)
    changes = run(spark, make(), tmp_path)
    once = spark.createDataFrame(rows, "station string, kind string, ts timestamp")
    once.coalesce(1).write.parquet(str(tmp_path / "all"))
    whole = run(spark, timers.coverage_changes(stream(spark, str(tmp_path / "all")), "station", "ts", F.col("kind"), delay="12h"), tmp_path / "b")
    as_of = F.lit(max(r[2] for r in rows))
    want = sorted(map(tuple, timers.coverage_now(whole, as_of).collect()))
    assert sorted(map(tuple, timers.coverage_now(changes, as_of).collect())) == want
    assert sorted(map(tuple, timers.coverage_now(changes.unionByName(changes), as_of).collect())) == want


@pytest.mark.parametrize("late_minutes", [0, 50])
def test_silence_equals_the_gaps(spark, tmp_path, late_minutes):
    rows = rows_of(3)
    files(spark, str(tmp_path / "in"), rows, 4, late_minutes, 7)
    changes = run(spark, timers.silence_changes(stream(spark, str(tmp_path / "in")), "station", "ts", "2h", delay="1h"), tmp_path)
    us = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    now = max(us(r[2]) for r in rows) - 3_600_000_000
    want = set()
    for station in ("hot", "thin", "late"):
        times = sorted({us(r[2]) for r in rows if r[0] == station and us(r[2]) <= now})
        want |= {(station, a, b) for a, b in zip(times[:-1], times[1:], strict=True) if b - a > 7_200_000_000}
        want |= {(station, times[-1], None)} if now - times[-1] >= 7_200_000_000 else set()
    found = timers.alerts(changes, "2h", "70h")
    assert {(r["key"], r["last_us"], r["back_us"]) for r in found.collect()} == want and len(want) > 10
    open_ones = sorted(k for k, _, back in want if back is None)
    title = timers.alert_title(found).collect()
    assert [r["title"].split(": ")[1].split(" silent")[0] for r in title] == ([", ".join(open_ones)] if open_ones else [])


def test_alert_title(spark):
    rows = [("offsite", 1_709_251_200_000_000, None), ("collector", 1_709_254_800_000_000, None), ("publisher", 1, 2)]
    found = spark.createDataFrame(rows, "key string, last_us long, back_us long")
    assert timers.alert_title(found).first()["title"] == "Collector watchdog: collector, offsite silent since 2024-03-01 00:00 UTC"
    assert timers.alert_title(found.where("back_us is not null")).count() == 0
