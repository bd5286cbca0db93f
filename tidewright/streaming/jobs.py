"""Structured Streaming jobs over observation and ledger streams.

Times are event times in UTC. Aggregates, duplicates and joins keep state only as long as the
watermark allows. Keyed state that must survive for ever is a change log of Parquet folders: a
batch writes its own folder (a replay overwrites it), and readers resolve the latest row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.base import duration_us, micros
from ..operators.qc import mean_std
from ..sources.ledgers import latest

# Fixed value: how long a source keeps its files, which bounds how late a row can be.
RETENTION = "72 hours"


def open_table(spark: SparkSession, folder: str, glob: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """An append-only CSV ledger as a stream; a line that doesn't fit the columns keeps its text in ``rejected``."""
    from ..sources.ledgers import LEDGER

    reader = spark.readStream.schema(f"{LEDGER}, rejected string").option("header", True).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "rejected").csv(folder)


def split_rejects(each: Callable[[DataFrame, int], None], rejects: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes rejected lines to a table and passes on the others."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        bad = rows.where("rejected is not null").select("rejected")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        each(rows.where("rejected is null").drop("rejected"), batch_id)
        rows.unpersist()

    return run


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All available input through ``foreachBatch``, then stop."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All available input to an exactly-once Parquet sink, then stop."""
    q = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q


def dropped_late_rows(q: StreamingQuery) -> int:
    """Rows that came after the watermark, from the progress of the query; they are not lost silently."""
    return sum(
        int(op.numRowsDroppedByWatermark) for p in q.recentProgress for op in p.stateOperators
    )


def hourly_counts(stream: DataFrame, time: str, by: Sequence[str], delay: str = RETENTION) -> DataFrame:
    """Rows per hour and key, emitted once the hour cannot change any more."""
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_utc"))
        .select(*by, F.col("w.start").alias("hour"), "n", "first_utc")
    )


def first_of_key(stream: DataFrame, time: str, keys: Sequence[str], delay: str = RETENTION) -> DataFrame:
    """One row per natural key among the rows the watermark still covers."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_sessions(stream: DataFrame, time: str, by: Sequence[str], gap: str, delay: str = RETENTION) -> DataFrame:
    """Runs of activity separated by at least ``gap``."""
    return (
        stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("s"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def interval_join(
    targets: DataFrame, references: DataFrame, by: Sequence[str], target_time: str, reference_time: str,
    within: str = "30 minutes", delay: str = RETENTION, how: str = "inner",
) -> DataFrame:
    """Arriving targets with the references within ``within`` of them; ``leftOuter`` keeps the rest."""
    a = targets.withWatermark(target_time, delay)
    b = references.withWatermark(reference_time, delay)
    span = F.expr(f"INTERVAL {within}")
    cond = (F.col(reference_time) >= F.col(target_time) - span) & (F.col(reference_time) <= F.col(target_time) + span)
    for c in by:
        cond = cond & (a[c] == b[c])
    return a.join(b, cond, how)


class ChangeLog:
    """A keyed table maintained by batches: last write wins, with an optional retention.

    ``delta/batch=N`` holds the rows of batch N reduced to one per key. Writing is idempotent.
    ``compact`` folds the log into a new base, so reads stay proportional to the table.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str], time: str | None = None, keep: str | None = None):
        self.path, self.keys, self.order, self.time, self.keep = path, list(keys), list(order), time, keep

    def write(self, batch: DataFrame, batch_id: int) -> None:
        latest(batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        parts = []
        for name in ("base", "delta"):
            if _has_files(spark, f"{self.path}/{name}"):
                parts.append(spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/{name}"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = latest(rows, self.keys, self.order)
        if self.keep:
            newest = rows.agg(F.max(micros(self.time))).first()[0]
            out = out.where(micros(self.time) >= (newest or 0) - duration_us(self.keep))
        return out

    def compact(self, spark: SparkSession, target: str) -> ChangeLog:
        """The current table as the base of a new log."""
        self.read(spark).write.mode("overwrite").parquet(f"{target}/base")
        return ChangeLog(target, self.keys, self.order, self.time, self.keep)


def _has_files(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def trailing_quality(
    history: str, by: Sequence[str], time: str, value: str, window: str = "24h", n_std: float = 3.0, **kw
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch tested against the ``window`` before its rows.

    History is kept by batch and day. A batch reads earlier batches only, so a replayed one gives the
    same flags, and only the days its window reaches, which are folders; older days are never opened.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        first = rows.agg(F.min(time)).first()[0]
        if first is not None:
            both = rows.withColumn("_new", F.lit(True))
            if _has_files(spark, f"{history}/rows"):
                start = F.lit(first) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(duration_us(window) / 1e6))
                old = spark.read.option("basePath", f"{history}/rows").parquet(f"{history}/rows")
                old = old.where((F.col("batch") < batch_id) & (F.col("day") >= F.to_date(start)) & (F.col(time) >= start))
                both = both.unionByName(old.drop("batch", "day").withColumn("_new", F.lit(False)))
            flagged = mean_std(both, by=by, time=time, value=value, window=window, n_std=n_std, **kw)
            flagged.where("_new").drop("_new").write.mode("overwrite").parquet(f"{history}/flags/batch={batch_id}")
            days = rows.withColumn("day", F.to_date(time))
            days.write.mode("overwrite").partitionBy("day").parquet(f"{history}/rows/batch={batch_id}")
        rows.unpersist()

    return each


def new_files(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Files changed after a time, for an incremental verification."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("modifiedAfter", since).load(path)
