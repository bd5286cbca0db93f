"""Providers: one way from files to checked observations. Fetching isn't part of it; files are read where they lie."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import suites
from ..session import materialise
from . import files, listings, stations


class Provider(Protocol):
    """What a provider of observations knows about its files."""

    dataset_id: str

    def discover(self, spark: SparkSession, folder: str) -> DataFrame:
        """``path, station_id, product, archive, size_bytes`` of the files it can read."""
        ...

    def read(self, spark: SparkSession, folder: str, product: str) -> DataFrame:
        """Lines of the files of a product: ``file, line, place``."""
        ...

    def parse(self, lines: DataFrame, product: str) -> DataFrame:
        """Lines to long rows of values with units."""
        ...

    def rejects(self, lines: DataFrame) -> DataFrame:
        """Lines that :meth:`parse` can't use, with the reason."""
        ...

    def normalise(self, parsed: DataFrame, product: str) -> DataFrame:
        """Long rows to the observation table (:data:`schema.OBSERVATION`)."""
        ...

    def validate(self, observations: DataFrame) -> DataFrame:
        """Heights with one flag column for each test of the provider's suite, and ``qc_flag``."""
        ...


@dataclass
class Ingested:
    """Everything that comes from one product of a provider."""

    observations: DataFrame
    flags: DataFrame
    rejects: DataFrame
    violations: DataFrame


def heights(observations: DataFrame, height: str = "wave_significant_height", period: str = "wave_peak_period") -> DataFrame:
    """``station_id, time_utc, height, period`` of a table of observations; the greatest value of a time counts."""
    value = lambda v: F.max(F.when(F.col("variable") == v, F.col("value")))
    rows = observations.where(F.col("variable").isin(height, period))
    return rows.groupBy("station_id", "time_utc").agg(value(height).alias("height"), value(period).alias("period"))


class StationFiles:
    """Station files by name: historical ``<station><code><year>.txt.gz``, realtime ``<station>.<extension>``."""

    dataset_id = "ndbc"
    suite = suites.SUITES["ndbc"]
    mappings = {"stdmet": schema.STATION_COLUMNS, "spec": schema.SUMMARY_COLUMNS}

    def _name(self, path: str | Column) -> dict[str, Column]:
        name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
        old, code, ext = name.rlike(listings.HISTORICAL_NAME), F.regexp_extract(name, listings.HISTORICAL_NAME, 2), F.regexp_extract(name, listings.REALTIME_NAME, 2)
        by_code = schema.literal_map([(p[4], p[0]) for p in listings.PRODUCTS if p[4]])
        by_ext = schema.literal_map([(p[2], p[0]) for p in listings.PRODUCTS if p[2]])
        station = F.when(old, F.regexp_extract(name, listings.HISTORICAL_NAME, 1)).otherwise(F.regexp_extract(name, listings.REALTIME_NAME, 1))
        return {
            "station_id": F.upper(station), "product": F.when(old, by_code[code]).otherwise(by_ext[ext]),
            "archive": F.when(old, "historical").otherwise("realtime"),
        }

    def discover(self, spark: SparkSession, folder: str) -> DataFrame:
        found = files.scan(spark, folder).withColumns(self._name("path"))
        return found.where("product is not null").select("path", "station_id", "product", "archive", "size_bytes")

    def read(self, spark: SparkSession, folder: str, product: str) -> DataFrame:
        return stations.read_lines(spark, folder).where(self._name("file")["product"] == product)

    def parse(self, lines: DataFrame, product: str) -> DataFrame:
        if not product.startswith("sw"):
            return stations.parse(lines, product)
        now = self._name("file")["archive"] == "realtime"
        both = (stations.parse(lines.where(now), product, realtime=True), stations.parse(lines.where(~now), product))
        return both[0].unionByName(both[1], allowMissingColumns=True)

    def rejects(self, lines: DataFrame) -> DataFrame:
        return stations.rejected_lines(lines)

    def normalise(self, parsed: DataFrame, product: str) -> DataFrame:
        if product not in self.mappings:
            raise ValueError(f"no observations are made of product {product!r}")
        rows = parsed.where("time_utc is not null").withColumn("station_id", self._name("file")["station_id"]).withColumnRenamed("file", "source_file")
        return schema.to_observations(rows, self.mappings[product], dataset=self.dataset_id, product=product)

    def validate(self, observations: DataFrame) -> DataFrame:
        rows = heights(observations)
        return suites.run(rows, self.suite, by=["station_id"], time="time_utc", height="height", period="period", tie="time_utc")[0]


class FieldSeries:
    """Decoded series of model fields, one table with a row for each station and time."""

    def __init__(self, dataset_id: str, columns, suite: suites.Suite):
        self.dataset_id, self.columns, self.suite = dataset_id, columns, suite

    def discover(self, spark: SparkSession, folder: str) -> DataFrame:
        return files.scan(spark, folder, ".parquet").select("path", F.col("top").alias("station_id"), F.lit("series").alias("product"), F.lit("archive").alias("archive"), "size_bytes")

    def read(self, spark: SparkSession, folder: str, product: str) -> DataFrame:
        return spark.read.parquet(folder)

    def parse(self, lines: DataFrame, product: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), F.lit(unit).alias("unit")) for c, _, unit in self.columns])
        source = F.col("source_file") if "source_file" in lines.columns else F.lit(None).cast("string")
        return lines.select("station_id", "time_utc", source.alias("file"), F.inline(cells)).where("value is not null")

    def rejects(self, lines: DataFrame) -> DataFrame:
        bad = F.when(F.col("time_utc").isNull(), "bad time").when(F.col("station_id").isNull(), "no station")
        return lines.select(*[c for c in ("station_id", "time_utc") if c in lines.columns], bad.alias("reason")).where("reason is not null")

    def normalise(self, parsed: DataFrame, product: str) -> DataFrame:
        mapping = [(c, v, None) for c, v, _ in self.columns]
        rows = parsed.where("time_utc is not null and station_id is not null").withColumnRenamed("file", "source_file")
        return schema.to_observations(rows, mapping, dataset=self.dataset_id, product=product, method="model")

    def validate(self, observations: DataFrame) -> DataFrame:
        return suites.run(heights(observations), self.suite, by=["station_id"], time="time_utc", height="height", period="period", tie="time_utc")[0]


def ingest_lines(provider: Provider, lines: DataFrame, product: str) -> Ingested:
    """Lines to observations, flags, rejected lines and violations of the contract."""
    observations = materialise(provider.normalise(provider.parse(lines, product), product))
    return Ingested(observations, provider.validate(observations), provider.rejects(lines), schema.violations(observations))


def ingest(provider: Provider, spark: SparkSession, folder: str, product: str) -> Ingested:
    """:func:`ingest_lines` of all files of a product below a folder."""
    return ingest_lines(provider, provider.read(spark, folder, product), product)
