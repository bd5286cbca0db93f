"""Retrieval ledgers: append-only CSV logs with one row per attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ledger columns.
LEDGER = (
    "source_id string, product string, station_id string, period string, url string, local_path string, sha256 string, "
    "size_bytes bigint, http_status int, http_last_modified string, http_etag string, retrieved_at timestamp, "
    "status string, software_version string, note string"
)
STATUSES = ("verified", "unchanged", "changed", "not_found", "failed")
NAMES = [c.split()[0] for c in LEDGER.split(", ")]


def read_ledger(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Typed ledger rows; a cut or malformed line is left out."""
    schema = T.StructType.fromDDL(LEDGER + "".join(f", {e} string" for e in extra))
    schema = schema.add("_corrupt", "string")
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")
        .csv(path)
    )
    return rows.where("_corrupt is null and retrieved_at is not null").drop("_corrupt")


def split_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Unquoted ledger lines to columns with a ``bad`` flag, NUL bytes removed and counted."""
    text = F.replace(F.col(line), F.lit("\u0000"), F.lit(""))
    parts = F.split(text, ",")
    keep = [c for c in lines.columns if c != line]
    at = F.get(parts, F.lit(NAMES.index("retrieved_at")))
    fields = [F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(NAMES)]
    rows = lines.select(
        *keep, (F.length(line) - F.length(text)).alias("nul_bytes"),
        ((F.size(parts) != len(NAMES)) | F.try_to_timestamp(at).isNull()).alias("bad"), *fields,
    )
    return rows.withColumns(
        {"size_bytes": F.col("size_bytes").try_cast("bigint"), "http_status": F.col("http_status").try_cast("int"),
         "retrieved_at": F.try_to_timestamp("retrieved_at")}
    )


def latest(ledger: DataFrame, keys: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The last row per key by ``order``, as an aggregate; later ties win by the further columns."""
    rows = ledger if where is None else ledger.where(where)
    others = [c for c in ledger.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def latest_by_url(ledger: DataFrame, order: list[str]) -> DataFrame:
    """Most recent successful entry per URL."""
    return latest(ledger, ["url"], order, F.col("sha256").isNotNull())


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.select(*NAMES).write.mode("append").option("header", True).csv(path)
