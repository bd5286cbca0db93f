"""Queries over files that are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import files
from .registry import Tables, query

LINE = "lpad(CAST(event_id AS VARCHAR), 8, '0') || ' ' || event_type || ' ' || CAST(user_id * 7 AS VARCHAR)"


def _folder(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/files-{uuid.uuid4().hex}"


def station_texts(t: Tables) -> str:
    """One text file per user, a line per event."""
    folder = _folder(t)
    k = F.lpad(F.col("event_id").cast("string"), 8, "0")
    line = F.concat_ws(" ", k, "event_type", (F.col("user_id") * 7).cast("string"))
    rows = t.events.select("user_id", line.alias("line"), F.concat(F.lit("station"), F.col("user_id").cast("string")).alias("top"))
    files.write_lines(rows.repartition("user_id").sortWithinPartitions("top", "line"), folder, top="top", line="line")
    return folder


def user_of(column: str):
    return F.regexp_extract(column, "top=station([0-9]+)", 1).cast("long")


@query(
    "file_heads",
    f"""SELECT user_id, CAST(row_number() OVER w AS BIGINT) AS line_no, {LINE} AS line FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY sum(strlen({LINE}) + 1) OVER (PARTITION BY user_id ORDER BY event_id) <= 300""",
)
def file_heads(t: Tables) -> DataFrame:
    """The complete lines in the first 300 bytes of each user's file."""
    return files.heads(t.spark, station_texts(t), 300, ".txt").select(user_of("path").alias("user_id"), "line_no", "line")


@query("file_scan", f"SELECT user_id, CAST(1 AS BIGINT) AS n_files, CAST(sum(strlen({LINE}) + 1) AS BIGINT) AS size_bytes FROM events GROUP BY 1")
def file_scan(t: Tables) -> DataFrame:
    found = files.scan(t.spark, station_texts(t), ".txt").groupBy("top")
    return found.agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes")).select(user_of("top").alias("user_id"), "n_files", "size_bytes")


@query(
    "newest_listing",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day FROM events), k AS (SELECT max(day) - 2 AS day FROM d)
    SELECT strftime(ts, '%Y%m%dT000000Z') AS stamp, user_id, count(*) AS n FROM events, k WHERE CAST(ts AS DATE) = k.day GROUP BY 1, 2""",
)
def newest_listing(t: Tables) -> DataFrame:
    """A JSON listing per day; the last two are cut, so the one before them counts."""
    folder = _folder(t)
    last = t.events.agg(F.max(F.to_date("ts")).alias("last")).first()["last"]
    day = F.to_date("ts")
    entries = t.events.groupBy(day.alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    listings = entries.groupBy("day").agg(F.to_json(F.array_sort(F.collect_list(F.struct("user_id", "n")))).alias("text"))
    cut = F.when(F.date_diff(F.lit(last), "day") < 2, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    rows = listings.select(F.date_format("day", "yyyyMMdd'T000000Z'").alias("snapshot"), cut.alias("text"))
    rows.write.partitionBy("snapshot").text(folder)
    kind = "array<struct<user_id:long,n:long>>"
    stamp = lambda p: F.nullif(F.regexp_extract(p, "snapshot=([0-9]{8}T[0-9]{6}Z)/", 1), F.lit(""))
    newest = files.newest_readable(t.spark, folder, stamp, lambda x: F.from_json(x, kind).isNotNull() & x.rlike("\\]\\s*$"), step=1)
    return newest.select("stamp", F.inline(F.from_json("text", kind)))
