"""Streams that must act when nothing arrives: coverage states per station and hour, and silence alerts.

Both keep keyed state with event-time timers and write change rows to a sink. What a change row says can only
be overtaken by a stronger one of the same key, so reading the sink is a reduction that doesn't depend on the
order of batches, and a replayed batch changes nothing.

Before the state, each task folds its rows to one per key and hour, so a station with a third of all rows
sends a few rows per batch to its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.base import DAY_US, HOUR_US, duration_us, micros

#: An hour's image is due so long after the hour, and can be fetched so long afterwards.
DUE_AFTER = "50min"
BACKFILL = "70h"
PENDING, GAP, NOT_PUBLISHED = ".", "?", "x"
#: Strongest first: an image overrules everything, the earlier one another; a known absence overrules a gap.
STRENGTH = "012345" + NOT_PUBLISHED + GAP + PENDING
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Timers need the state store that keeps its state on disk; a query keeps the one it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.table(batch).group_by(["key", "kind", "slot"]).aggregate([("us", "min"), ("us", "max"), ("time_utc", "max")])
        table = table.select(["key", "kind", "slot", "us_min", "us_max", "time_utc_max"]).rename_columns(["key", "kind", "slot", "first_us", "last_us", "time_utc"])
        yield from table.to_batches()


def folded(stream: DataFrame, key: str, time: str, kind: Column, slot_us: int, delay: str) -> DataFrame:
    """``key, kind, slot, first_us, last_us`` of the rows of each task, key, kind and slot of time, with a watermark."""
    us = micros(time)
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).cast("string").alias("key"), kind.cast("string").alias("kind"), F.floor(us / slot_us).cast("bigint").alias("slot"),
        us.alias("us"), F.col(time).cast("timestamp").alias("time_utc"),
    )
    out = rows.mapInArrow(_fold, "key string, kind string, slot long, first_us long, last_us long, time_utc timestamp")
    return out.withWatermark("time_utc", f"{duration_us(delay) // 1000} milliseconds")


class Coverage(StatefulProcessor):
    """Per station one 24-character text for each day that can still change, and the next hour to judge.

    The clock is the watermark plus its delay: the latest time seen. So an hour without an image is a gap as
    soon as it is due, while rows that are late by less than the delay still count.
    """

    def __init__(self, due_us: int, delay_us: int, keep_us: int):
        self.due_us, self.delay_us, self.keep_us = due_us, delay_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "codes string")
        self.span = handle.getValueState("span", "first long, judged long")

    def _read(self, cache: dict[int, list[str]], hour: int) -> list[str]:
        day = hour // 24
        if day not in cache:
            cache[day] = list(self.days.getValue((day,))[0]) if self.days.exists() and self.days.containsKey((day,)) else [PENDING] * 24
        return cache[day]

    def _set(self, cache: dict, hour: int, code: str) -> bool:
        codes = self._read(cache, hour)
        if STRENGTH.index(code) >= STRENGTH.index(codes[hour % 24]):
            return False
        codes[hour % 24] = code
        return True

    def _finish(self, key: tuple, cache: dict, changed: set[int], first: int, judged: int) -> Iterator[Row]:
        for day, codes in cache.items():
            self.days.updateValue((day,), ("".join(codes),))
        self.span.update((first, judged))
        for hour in sorted(changed):
            yield Row(key=key[0], hour_us=hour * HOUR_US, code=cache[hour // 24][hour % 24])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cache: dict[int, list[str]] = {}
        changed: set[int] = set()
        first, judged = self.span.get() if self.span.exists() else (None, None)
        for r in rows:
            code = str(min(r["first_us"] % HOUR_US // (600 * 1_000_000), 5)) if r["kind"] == "image" else NOT_PUBLISHED
            hour = r["slot"]
            if first is None:
                first = judged = hour
            for missed in range(hour, min(first, judged)):  # a station began earlier than known
                if self._set(cache, missed, GAP):
                    changed.add(missed)
            first = min(first, hour)
            if self._set(cache, hour, code):
                changed.add(hour)
        yield from self._finish(key, cache, changed, first, judged)
        self._next(judged)

    def _next(self, judged: int) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-(judged * HOUR_US + self.due_us - self.delay_us) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 + self.delay_us
        cache: dict[int, list[str]] = {}
        changed: set[int] = set()
        first, judged = self.span.get()
        while judged * HOUR_US + self.due_us <= now:
            if self._set(cache, judged, GAP):
                changed.add(judged)
            judged += 1
        yield from self._finish(key, cache, changed, first, judged)
        for (day,) in [k for k in self.days.keys() if (k[0] + 1) * DAY_US + self.keep_us <= now]:
            self.days.removeKey((day,))
        self.handle.registerTimer(-(-(judged * HOUR_US + self.due_us - self.delay_us) // 1000))

    def close(self) -> None:
        pass


def coverage_changes(stream: DataFrame, key: str, time: str, kind: Column, due_after: str = DUE_AFTER, delay: str = BACKFILL, keep: str = "72h") -> DataFrame:
    """Change rows ``key, hour_us, code`` from rows whose ``kind`` is ``image`` or ``not_found``.

    Codes are the minute digit of the hour's first image, ``x`` (not published) and ``?`` (due and missing).
    Rows later than ``delay`` behind the latest time are dropped; state of days older than ``keep`` is too.
    """
    rows = folded(stream, key, time, kind, HOUR_US, delay)
    processor = Coverage(duration_us(due_after), duration_us(delay), max(duration_us(keep), duration_us(delay)))
    return rows.groupBy("key").transformWithState(processor, "key string, hour_us long, code string", "Append", "EventTime")


def coverage_now(changes: DataFrame, as_of: Column, due_after: str = DUE_AFTER) -> DataFrame:
    """``key, hour_us, code`` of every hour from a station's first one to ``as_of``; hours not yet due are pending."""
    strength = F.expr(f"locate(code, '{STRENGTH}')")
    known = changes.groupBy("key", "hour_us").agg(F.min_by("code", strength).alias("code"))
    hour_of = lambda us: F.floor(us / HOUR_US).cast("bigint")
    now = hour_of(micros(as_of))
    open_from = F.greatest(hour_of(micros(as_of) - duration_us(due_after)) + 1, hour_of(F.col("first")))
    spans = known.groupBy("key").agg(F.min("hour_us").alias("first")).where(open_from <= now)
    hours = spans.select("key", F.explode(F.sequence(open_from, now)).alias("hour"))
    pending = hours.select("key", (F.col("hour") * HOUR_US).alias("hour_us")).join(known, ["key", "hour_us"], "left_anti")
    return known.unionByName(pending.withColumn("code", F.lit(PENDING)))


class Silence(StatefulProcessor):
    """Per key the last time up to the watermark, and what came after it as the first and last time of each slot.

    A slot is as long as the allowed silence, so no silence fits into one and its ends are all that is needed.
    """

    def __init__(self, max_us: int):
        self.max_us = max_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getMapState("ahead", "slot long", "first long, last long")
        self.last = handle.getValueState("last", "us long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: tuple(v) for k, v in self.ahead.iterator()} if self.ahead.exists() else {}
        for r in rows:
            first, last = held.get(r["slot"], (r["first_us"], r["last_us"]))
            held[r["slot"]] = (min(first, r["first_us"]), max(last, r["last_us"]))
            self.ahead.updateValue((r["slot"],), held[r["slot"]])
        if held:
            self._wake(min(first for first, _ in held.values()))
        return iter(())

    def _wake(self, us: int) -> None:
        at = -(-us // 1000)
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, told = self.last.get() if self.last.exists() else (None, False)
        held = sorted((k[0], *v) for k, v in self.ahead.iterator()) if self.ahead.exists() else []
        for slot, first, latest in held:
            if first > now:
                break
            if last is not None and first - last > self.max_us:
                yield Row(key=key[0], last_us=last, back_us=first)
            if latest > now:
                last, told = max(first, last or first), False
                break
            last, told = max(latest, last or latest), False
            self.ahead.removeKey((slot,))
        if last is not None and not told and now - last >= self.max_us:
            told = True
            yield Row(key=key[0], last_us=last, back_us=None)
        if last is not None:
            self.last.update((last, told))
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        after = [max(first, now + 1) if first > now else latest for _, first, latest in held if latest > now]
        if last is not None and not told:
            after.append(last + self.max_us)
        if after:
            self._wake(min(after))

    def close(self) -> None:
        pass


def silence_changes(stream: DataFrame, key: str, time: str, max_age: str, delay: str = "1h") -> DataFrame:
    """Change rows ``key, last_us, back_us``: silent since a time, and when it ended (null: it goes on)."""
    rows = folded(stream, key, time, F.lit("row"), duration_us(max_age), delay)
    return rows.groupBy("key").transformWithState(Silence(duration_us(max_age)), "key string, last_us long, back_us long", "Append", "EventTime")


def alerts(changes: DataFrame, max_age: str, lost_after: str) -> DataFrame:
    """One row per silence: ``key, last_us, alert_us, lost_us, back_us``; data are lost once the backfill window has passed."""
    last = F.col("last_us")
    return changes.groupBy("key", "last_us").agg(F.min("back_us").alias("back_us")).select(
        "key", "last_us", (last + duration_us(max_age)).alias("alert_us"), (last + HOUR_US + duration_us(lost_after)).alias("lost_us"), "back_us"
    )


def alert_title(open_alerts: DataFrame, watcher: str = "Collector watchdog") -> DataFrame:
    """One row ``title`` naming the silent keys and the oldest of their times; none if nothing is silent."""
    names = F.array_join(F.array_sort(F.collect_set("key")), ", ")
    since = F.date_format(F.timestamp_micros(F.min("last_us")), "yyyy-MM-dd HH:mm 'UTC'")
    one = open_alerts.where(F.col("back_us").isNull()).agg(F.count(F.lit(1)).alias("n"), names.alias("names"), since.alias("since"))
    return one.where("n > 0").select(F.concat(F.lit(f"{watcher}: "), "names", F.lit(" silent since "), "since").alias("title"))
