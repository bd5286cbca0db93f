"""Tables to files: partitioned observations, reports, checksums and provenance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_standardized(df: DataFrame, path: str, by: tuple[str, ...] = ("station_id", "period", "grid_id"), files_per_key: int = 1) -> None:
    """Parquet folders per key. A hot key is spread over ``files_per_key`` tasks and files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
    df.withColumn("_salt", salt).repartition(*by, "_salt").drop("_salt").write.mode("append").partitionBy(*by).parquet(path)


def write_report(files: DataFrame, problems: DataFrame, ledgers: DataFrame, path: str) -> None:
    """Per-file results, problems and ledger counts as gzip CSV."""
    for name, df in (("files", files), ("problems", problems), ("ledgers", ledgers)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}", compression="gzip")


def checksum_lines(files: DataFrame) -> DataFrame:
    """``<sha256>  <path>`` lines of a ``binaryFile`` table or of any table with path and content."""
    return files.select(F.concat(F.sha2("content", 256), F.lit("  "), F.col("path")).alias("value"))


def write_checksums(files: DataFrame, path: str) -> None:
    checksum_lines(files).write.mode("overwrite").text(path)


def config_hash(config: dict) -> str:
    """sha256 of the configuration as sorted JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def write_provenance(inputs: DataFrame, config: dict, path: str) -> None:
    """One JSON row per input file with its checksum and the configuration hash."""
    rows = inputs.select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.lit(config_hash(config)).alias("config_hash")
    )
    rows.write.mode("overwrite").json(path)
