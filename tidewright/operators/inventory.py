"""Inventory: station lists joined, references of camera sites, wave stations, profilers, problems of a registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import micros
from ..functions.geo import haversine_m
from ..session import materialise
from .assembly import refuse
from .skew import salted_join


def merge_station_lists(xml: DataFrame, table: DataFrame) -> DataFrame:
    """Stations of either list, one row each; what a list doesn't know is NULL.

    Columns that both have besides ``station_id`` are taken from the first list where it has a value.
    """
    shared = [c for c in xml.columns if c in table.columns and c != "station_id"]
    other = table.withColumnsRenamed({c: f"_{c}" for c in shared})
    both = xml.join(other, "station_id", "full")
    return both.withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(*[f"_{c}" for c in shared])


def resolve_references(references: DataFrame, stations: DataFrame) -> DataFrame:
    """References of camera sites with their position and ``distance_km`` from the site, to a tenth.

    ``references``: site_id, site_lat, site_lon, station_id, and name, lat, lon where they are given; what isn't
    given is the station's. A reference without a position is refused, all of them named by number.
    """
    known = stations.select(F.upper("station_id").alias("_id"), F.col("name").alias("_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    rows = salted_join(references.withColumn("_id", F.upper("station_id")), known, ["_id"], how="left")
    rows = materialise(rows.withColumns({c: F.coalesce(c, f"_{c}") for c in ("name", "lat", "lon")}).drop("_id", "_name", "_lat", "_lon"))
    refuse({"references without a position": rows.where("lat is null or lon is null").count()})
    return rows.withColumn("distance_km", F.round(haversine_m("site_lat", "site_lon", "lat", "lon") / 1000, 1))


def numbered_name(name: str | Column, digits: int = 3) -> Column:
    """Whether a name ends in a number in brackets, as those of one network do."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(c.rlike(rf"\(\d{{{digits}}}\)\s*$"), F.lit(False))


def wave_stations(files: DataFrame, stations: DataFrame, year: int, *, owner: str = "SCRIPPS", network: str = "CDIP") -> DataFrame:
    """(station_id, filename, label, network, latitude, longitude) of wave stations with meteorological values of a year.

    A wave station has a spectral file of that year, or its owner or the number in its name tells that it is one of
    the network. Of several first-segment files the first name is taken; stations without a position are left out.
    """
    hist = files.where((F.col("archive") == "historical") & (F.col("year") == year))
    label = F.coalesce("name", "table_name")
    member = F.coalesce(F.col("owner") == owner, F.lit(False)) | numbered_name(label)
    named = stations.where("latitude is not null and longitude is not null").select(
        "station_id", label.alias("label"), F.when(member, network).otherwise(F.coalesce("owner", F.lit(""))).alias("network"),
        "latitude", "longitude", member.alias("_member"),
    )
    std = F.when((F.col("product") == "stdmet") & (F.col("segment") == "a"), F.col("filename"))
    # One pass over the files: the name, and whether there is a spectrum.
    have = hist.groupBy("station_id").agg(F.min(std).alias("filename"), F.bool_or(F.col("product") == "swden").alias("_spectra"))
    rows = have.where("filename is not null").join(named, "station_id")
    return rows.where("_spectra or _member").select("station_id", "filename", "label", "network", "latitude", "longitude")


def profiler_availability(files: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Stations with current profiles: first and last year, number of years, and of years that have spectra, too."""
    hist = files.where("archive = 'historical' and year is not null")
    current, spectrum = F.col("product").isin("adcp", "adcp2"), F.col("product") == "swden"
    years = hist.groupBy("station_id", "year").agg(F.bool_or(current).alias("_a"), F.bool_or(spectrum).alias("_s")).where("_a")
    out = years.groupBy("station_id").agg(
        F.min("year").alias("adcp_first"), F.max("year").alias("adcp_last"), F.count(F.lit(1)).alias("adcp_years"), F.count_if("_s").alias("adcp_and_spectrum_years")
    )
    return out if summary is None else salted_join(out, summary, ["station_id"], how="left")


# States of the check of a registered data set.
VERIFICATION = ("verified", "documented", "candidate")


def registry_problems(entries: DataFrame, *, required: Sequence[str] = ("dataset_id", "name", "provider"), states: Sequence[str] = VERIFICATION) -> DataFrame:
    """(dataset_id, problem) of everything wrong in a registry of data sets; empty if it is valid.

    ``entries`` has the required texts, ``status`` and ``evidence`` (an array). An entry without an id is named by ``position``.
    """
    name = F.coalesce(F.nullif("dataset_id", F.lit("")), F.concat(F.lit("#"), F.col("position").cast("string")))
    known = F.coalesce(F.col("status").isin(list(states)), F.lit(False))
    bare = (F.col("status") == "verified") & (F.coalesce(F.size("evidence"), F.lit(0)) < 1)
    checks = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c}: missing")) for c in required]
    checks += [F.when(~known, F.lit("status: unknown")), F.when(bare, F.lit("verified without evidence"))]
    own = entries.select(name.alias("dataset_id"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    twice = entries.where("trim(dataset_id) <> ''").groupBy("dataset_id").count().where("count > 1").select("dataset_id", F.lit("duplicate dataset_id").alias("problem"))
    return own.unionByName(twice)


def expand_sets(names: DataFrame, sets: DataFrame) -> DataFrame:
    """(list, position, camera): lists of cameras with ``@set`` names replaced by the cameras of the set, each once, at its first place.

    ``names``: list, position, name. ``sets``: set, position, camera. A set that doesn't exist is refused.
    """
    marked = names.withColumn("_set", F.when(F.col("name").startswith("@"), F.substring("name", 2, 1_000)))
    members = sets.groupBy(F.col("set").alias("_set")).agg(F.array_sort(F.collect_list(F.struct("position", "camera"))).alias("_members"))
    rows = materialise(marked.join(members, "_set", "left"))
    refuse({"names of unknown sets": rows.where("_set is not null and _members is null").count()})
    single = F.array(F.struct(F.lit(0).cast("bigint").alias("position"), F.col("name").alias("camera")))
    cameras = F.coalesce(F.transform("_members", lambda m: F.struct(m["position"].cast("bigint").alias("position"), m["camera"].alias("camera"))), single)
    flat = rows.select("list", "position", F.explode(cameras).alias("m"))
    first = flat.groupBy("list", F.col("m.camera").alias("camera")).agg(F.min(F.struct("position", F.col("m.position").alias("place"))).alias("_p"))
    return first.select("list", "_p.position", "_p.place", "camera")


def listed_this_hour(images: DataFrame, by: Sequence[str], time: str, output: str = "cameras_this_hour") -> DataFrame:
    """Each image with the number of images of its station and time stamp."""
    counts = images.groupBy(*by, time).agg(F.count(F.lit(1)).alias(output))
    return salted_join(images, counts, [*by, time], how="left")


def other_camera_offset(images: DataFrame, by: Sequence[str], stamp: str, camera: str, time: str, pair: tuple[str, str], output: str = "other_camera_offset_s") -> DataFrame:
    """Seconds from the other camera's image of the same named hour to this one; NULL if either camera has none.

    Of several images of a camera and hour the earliest counts.
    """
    us = {c: F.min(F.when(F.col(camera) == c, micros(time))) for c in pair}
    hours = images.where(F.col(camera).isin(list(pair))).groupBy(*by, stamp).agg(((us[pair[0]] - us[pair[1]]) / 1e6).alias("_gap"))
    rows = salted_join(images, hours, [*by, stamp], how="left")
    sign = F.when(F.col(camera) == pair[0], 1.0).when(F.col(camera) == pair[1], -1.0)
    return rows.withColumn(output, F.col("_gap") * sign).drop("_gap")


def attach_previous_hour(df: DataFrame, time: str, hourly: DataFrame, hour: str, hours_back: int = 1) -> DataFrame:
    """Each row with the hourly record of the hour before its own; an hour that is listed twice is refused."""
    table = materialise(hourly)
    twice = table.groupBy(hour).count().where("count > 1").count()
    refuse({f"hours listed twice in {hour}": twice})
    at = F.timestamp_micros(micros(F.date_trunc("hour", F.col(time).cast("timestamp"))) - F.lit(hours_back * 3_600_000_000))
    return salted_join(df.withColumn(hour, at), table.withColumn(hour, F.col(hour).cast("timestamp")), [hour], how="left")


def tier_counts(df: DataFrame, value: str, edges: Sequence[float], *, day: str, window: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., class, clips, dates, windows) of rows with a value: class k between two edges, -1 below, the last one above."""
    v = F.col(value)
    cls = F.when(v < edges[0], -1).otherwise(sum(((v >= e).cast("int") for e in edges), F.lit(-1)))
    rows = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    return rows.groupBy(*by, cls.alias("class")).agg(F.count(F.lit(1)).alias("clips"), F.count_distinct(day).alias("dates"), F.count_distinct(F.struct(*window)).alias("windows"))


def stage_coverage(df: DataFrame, stages: dict[str, Column], *, group: str, time: str) -> DataFrame:
    """(position, stage, rows, groups, first_utc, last_utc) of the rows that pass every stage up to this one, in one pass."""
    passed, counts = F.lit(True), []
    for i, (name, holds) in enumerate(stages.items()):
        passed = passed & F.coalesce(holds, F.lit(False))
        kept = lambda c, p=passed: F.when(p, F.col(c))
        counts.append((i, name, F.count_if(passed), F.count_distinct(kept(group)), F.min(kept(time)), F.max(kept(time))))
    wide = df.agg(*[c.alias(f"{what}{i}") for i, _, *cells in counts for what, c in zip("ngab", cells, strict=True)])
    each = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.col(f"n{i}").alias("rows"), F.col(f"g{i}").alias("groups"), F.col(f"a{i}").alias("first_utc"), F.col(f"b{i}").alias("last_utc"))
        for i, name, *_ in counts
    ]
    return wide.select(F.inline(F.array(*each)))
