"""The observation contract: columns, registered variables, units, coercion and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.qc import FLAG_NAMES, NOT_EVALUATED

_S, _D, _T, _B = T.StringType(), T.DoubleType(), T.TimestampType(), T.ByteType()
# The column contract of the long observation table.
OBSERVATION = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("observation_id", _S), ("dataset_id", _S), ("station_id", _S), ("platform_id", _S), ("sensor_id", _S),
            ("deployment_id", _S), ("time_utc", _T), ("time_reference", _S), ("averaging_period_s", _D),
            ("latitude", _D), ("longitude", _D), ("depth_m", _D), ("variable", _S), ("value", _D), ("units", _S),
            ("method", _S), ("source_qc_flag", _S), ("project_qc_flag", _B), ("source_file", _S), ("source_url", _S),
            ("download_timestamp", _T), ("source_checksum", _S), ("processing_level", _S), ("processing_version", _S),
        ]
    ]
)
REQUIRED = (
    "observation_id", "dataset_id", "station_id", "time_utc", "variable", "units", "source_file", "processing_version",
)
# Canonical unit of each registered variable.
VARIABLE_UNITS = {
    "wave_significant_height": "m", "wave_peak_period": "s", "wave_mean_period": "s", "wave_mean_period_tm01": "s",
    "wave_mean_period_tm02": "s", "wave_energy_period": "s", "wave_zero_upcrossing_period": "s",
    "wave_maximum_height": "m", "wave_from_direction_at_peak": "degree", "wave_mean_from_direction": "degree",
    "swell_significant_height": "m", "swell_period": "s", "swell_energy_period": "s", "swell_from_direction": "degree",
    "wind_wave_significant_height": "m", "wind_wave_period": "s", "wind_wave_energy_period": "s",
    "wind_wave_from_direction": "degree", "wave_spectral_density": "m2 s", "wind_speed": "m s-1",
    "wind_speed_of_gust": "m s-1", "wind_from_direction": "degree", "air_pressure_at_sea_level": "hPa",
    "air_pressure_tendency": "hPa", "air_temperature": "degree_Celsius", "sea_surface_temperature": "degree_Celsius",
    "dew_point_temperature": "degree_Celsius", "visibility": "m", "water_level": "m",
}
# Provider unit, canonical unit, factor.
UNIT_FACTORS = [
    ("m/s", "m s-1", 1.0), ("m", "m", 1.0), ("sec", "s", 1.0), ("degT", "degree", 1.0), ("hPa", "hPa", 1.0),
    ("degC", "degree_Celsius", 1.0), ("nmi", "m", 1852.0), ("mi", "m", 1609.344), ("ft", "m", 0.3048),
]
# Station-table column, canonical variable, averaging period in seconds.
STATION_COLUMNS = [
    ("WDIR", "wind_from_direction", 480.0), ("WSPD", "wind_speed", 480.0), ("GST", "wind_speed_of_gust", None),
    ("WVHT", "wave_significant_height", 1200.0), ("DPD", "wave_peak_period", 1200.0), ("APD", "wave_mean_period", 1200.0),
    ("MWD", "wave_from_direction_at_peak", 1200.0), ("PRES", "air_pressure_at_sea_level", None),
    ("PTDY", "air_pressure_tendency", None), ("ATMP", "air_temperature", None), ("WTMP", "sea_surface_temperature", None),
    ("DEWP", "dew_point_temperature", None), ("VIS", "visibility", None), ("TIDE", "water_level", None),
]
# Summary column, canonical variable (both directions come from compass points).
SUMMARY_COLUMNS = [
    ("SwH", "swell_significant_height", 1200.0), ("SwP", "swell_period", 1200.0), ("SwD", "swell_from_direction", 1200.0),
    ("WWH", "wind_wave_significant_height", 1200.0), ("WWP", "wind_wave_period", 1200.0),
    ("WWD", "wind_wave_from_direction", 1200.0),
]
# Derived parameter, canonical variable, method tag.
DERIVED_COLUMNS = [
    ("Hm0", "wave_significant_height", "spectral_hm0"), ("Tp_smooth", "wave_peak_period", "spectral_tp_young1995"),
    ("Tm01", "wave_mean_period_tm01", "spectral_tm01"), ("Tm02", "wave_mean_period_tm02", "spectral_tm02"),
    ("Dm", "wave_mean_from_direction", "spectral_dm_kuik1988"),
]
VERSION = "1"


def literal_map(pairs) -> Column:
    """A small fixed dictionary as a map column."""
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def units_of(variable: Column) -> Column:
    return literal_map(VARIABLE_UNITS.items())[variable]


def is_angle(variable: Column) -> Column:
    return variable.isin([k for k, u in VARIABLE_UNITS.items() if u == "degree"])


def convert(value: Column, from_unit: Column, to_unit: Column) -> Column:
    """Value in the canonical unit; NULL for a pair without a factor (see ``unknown_units``)."""
    factors = literal_map([(f"{a}>{b}", f) for a, b, f in UNIT_FACTORS])
    scaled = value * factors[F.concat(from_unit, F.lit(">"), to_unit)]
    return F.when(to_unit == "degree", F.pmod(scaled, F.lit(360.0))).otherwise(scaled)


def unknown_units(df: DataFrame, from_unit: str, to_unit: str) -> DataFrame:
    """Unit pairs of the data that have no registered factor."""
    known = [f"{a}>{b}" for a, b, _ in UNIT_FACTORS]
    return df.select(from_unit, to_unit).distinct().where(
        ~F.concat(from_unit, F.lit(">"), to_unit).isin(known) | F.col(from_unit).isNull()
    )


def iso_utc(time: Column) -> Column:
    """ISO 8601 with Z; fractions only where there are any."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(time, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def observation_id(*parts: Column | str) -> Column:
    """``dataset:station:product:variable:time`` from literals and columns; stable on re-ingestion."""
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def coerce(df: DataFrame) -> DataFrame:
    """Missing columns added, all cast and ordered; a missing project flag is NOT_EVALUATED."""
    out = []
    for f in OBSERVATION:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        if f.name == "project_qc_flag":
            c = F.coalesce(c, F.lit(NOT_EVALUATED).cast("tinyint"))
        out.append(c.alias(f.name))
    return df.select(*out)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OBSERVATION)


def to_observations(
    long: DataFrame, mapping, *, dataset: str, product: str, level: str = "standardized", method: str = "provider_reported"
) -> DataFrame:
    """Provider rows ``station_id, time_utc, column, value, unit, source_file`` to observations.

    ``mapping`` lists (column, variable, averaging period); other columns and missing values are
    left out.
    """
    variables = literal_map([(c, v) for c, v, _ in mapping])
    averaging = F.create_map(
        *[x for c, _, a in mapping for x in (F.lit(c), F.lit(a).cast("double"))]
    )
    rows = long.where(F.col("column").isin([c for c, _, _ in mapping]) & F.col("value").isNotNull())
    rows = rows.withColumn("variable", variables[F.col("column")])
    rows = rows.withColumn("units", units_of(F.col("variable")))
    rows = rows.withColumns(
        {
            "value": convert(F.col("value"), F.col("unit"), F.col("units")),
            "averaging_period_s": averaging[F.col("column")],
            "dataset_id": F.lit(dataset),
            "platform_id": F.col("station_id"),
            "time_reference": F.lit("nominal"),
            "method": F.lit(method),
            "processing_level": F.lit(level),
            "processing_version": F.lit(VERSION),
            "observation_id": observation_id(
                dataset, F.col("station_id"), product, F.col("variable"), iso_utc(F.col("time_utc"))
            ),
        }
    )
    return coerce(rows)


def derived_observations(bulk: DataFrame, *, dataset: str, station: str, time: str, source_file: Column) -> DataFrame:
    """Bulk parameters of spectra as derived observations, each tagged with its estimator."""
    cols = [(c, v, m) for c, v, m in DERIVED_COLUMNS if c in bulk.columns]
    parts = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.lit(m).alias("method"), F.col(c).cast("double").alias("value"))
            for c, v, m in cols
        ]
    )
    rows = bulk.select(
        F.col(station).alias("station_id"), F.col(time).alias("time_utc"), source_file.alias("source_file"), F.inline(parts)
    ).where("value is not null")
    return coerce(
        rows.withColumns(
            {
                "dataset_id": F.lit(dataset),
                "platform_id": F.col("station_id"),
                "units": units_of(F.col("variable")),
                "averaging_period_s": F.lit(1200.0),
                "time_reference": F.lit("nominal"),
                "processing_level": F.lit("derived"),
                "processing_version": F.lit(VERSION),
                "observation_id": observation_id(
                    dataset, F.col("station_id"), "spectrum_derived", F.col("variable"), iso_utc(F.col("time_utc"))
                ),
            }
        )
    )


def violations(df: DataFrame) -> DataFrame:
    """(check, n) of every violated rule; all row checks are one aggregate."""
    missing = [f.name for f in OBSERVATION if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    v, x = F.col("variable"), F.col("value")
    known = v.isin(list(VARIABLE_UNITS))
    checks = {f"null {c}": F.col(c).isNull() for c in REQUIRED}
    checks["unknown variable"] = v.isNotNull() & ~known
    checks["units not canonical"] = known & (F.col("units") != units_of(v))
    checks["angle outside [0, 360)"] = is_angle(v) & ((x < 0) | (x >= 360))
    checks["invalid project_qc_flag"] = ~F.col("project_qc_flag").isin(list(FLAG_NAMES))
    counts = df.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    names = F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("n")) for k in checks])
    dup = df.groupBy("observation_id").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n")
    )
    dup = dup.select(F.lit("duplicate observation_id").alias("check"), "n")
    return counts.select(F.inline(names)).unionByName(dup).where("n > 0")


def validate(df: DataFrame) -> None:
    """Raise with every violation listed (at most one row per rule reaches the driver)."""
    found = violations(df).collect()
    if found:
        raise ValueError("; ".join(f"{r['check']}: {r['n']}" for r in found))
