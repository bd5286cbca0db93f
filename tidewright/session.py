"""Session settings shared by every job: UTC, checkpoint folder, task-size limits."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = "tidewright.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 5_000_000
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def use_utc(spark: SparkSession) -> SparkSession:
    """All time arithmetic is done in UTC microseconds."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return use_utc(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def rows_per_task(spark: SparkSession) -> int:
    """The largest group of rows one task may sort by itself."""
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
    elif is_local(spark):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so later branches read the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
