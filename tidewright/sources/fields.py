"""Decoded buoy arrays and model grids as long tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import polar_from_fourier
from ..functions.base import divide, finite
from ..functions.geo import EARTH_RADIUS_M, haversine_m
from ..operators.align import point_in_interval
from ..operators.skew import salted_join
from ..operators.stations import _cells
from ..session import materialise


def melt(wide: DataFrame, ids: Sequence[str], mapping: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Columns to rows ``variable, method, value``; missing values are left out.

    ``mapping`` lists (column, variable, method) of a provider; angles come out in [0, 360).
    """
    from ..schema import is_angle

    items = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.lit(m).alias("method"), finite(c).alias("value"))
            for c, v, m in mapping
        ]
    )
    rows = wide.select(*ids, F.inline(items)).where("value is not null")
    angle = F.pmod("value", F.lit(360.0))
    return rows.withColumn("value", F.when(is_angle(F.col("variable")), angle).otherwise(F.col("value")))


def coefficient_spectrum(bands: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Band rows ``energy_density, a1, b1, a2, b2`` to density and alpha/r, provider bandwidth kept."""
    al1, al2, r1, r2 = polar_from_fourier("a1", "b1", "a2", "b2")
    return bands.select(
        *keep, "frequency_hz", "bandwidth_hz", F.col("energy_density").alias("spectral_density_m2_hz"),
        al1.alias("alpha1"), al2.alias("alpha2"), r1.alias("r1"), r2.alias("r2"),
    )


def mixed_grid_sizes(bands: DataFrame, record: Sequence[str]) -> DataFrame:
    """Numbers of bands per record, if there is more than one."""
    sizes = bands.groupBy(*record).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("records"))
    kinds = F.broadcast(sizes.agg(F.count(F.lit(1)).alias("k")).withColumn("_1", F.lit(1)))  # one row
    return sizes.withColumn("_1", F.lit(1)).join(kinds, "_1").where("k > 1").drop("k", "_1")


def with_deployment(records: DataFrame, deployments: DataFrame, index: str, keys: Sequence[str]) -> DataFrame:
    """Deployment of each record by its 1-based index; a bad index gives NULLs."""
    numbered = deployments.withColumnRenamed("number", "_number")
    out = records.withColumn("_number", F.col(index) - 1)
    return salted_join(out, numbered, [*keys, "_number"], how="left").drop("_number")


def deployment_at(records: DataFrame, deployments: DataFrame, *, by: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Deployment whose half-open validity holds the record; an open end is in the future."""
    far = F.lit("9999-12-31").cast("timestamp")
    spans = deployments.withColumn("_end", F.coalesce(F.col("end_utc").cast("timestamp"), far))
    return point_in_interval(records, spans, by=by, time=time, start="start_utc", end="_end", values=values)


def nearest_points(sites: DataFrame, points: DataFrame, *, start_km: float = 50.0) -> DataFrame:
    """The nearest usable grid point of each site: ``site, point, distance_km``.

    ``sites``: site, lat, lon. ``points``: point, lat, lon. Partners are looked for in
    neighbouring cells; sites without one look again twice as far, so the result is exact without
    comparing every site with every point. The first cells are at most ``start_km`` wide, and narrower
    the more positions there are, so a cell holds a few of them on average.
    """
    left = materialise(sites.select("site", "lat", "lon"))
    # Points at one position are one row: the lowest of them is the nearest.
    spots = points.where("lat is not null and lon is not null").groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    right = materialise(spots.agg(F.min(F.struct("point")).alias("_p")).select("_p.point", "plat", "plon"))
    spacing = 2 * EARTH_RADIUS_M / 1000 * math.sqrt(math.pi / max(right.count(), 1))
    found, km = None, min(start_km, spacing)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
                      for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    while True:
        x, y, z = _cells("lat", "lon", km * 1000)
        a = left.select("*", x.alias("x"), y.alias("y"), z.alias("z"), F.explode(steps).alias("s")).select(
            "site", "lat", "lon", *[(F.col(c) + F.col(f"s.{s}")).alias(c) for c, s in zip("xyz", "ijk", strict=True)]
        )
        u, v, w = _cells("plat", "plon", km * 1000)
        b = right.select("*", u.alias("x"), v.alias("y"), w.alias("z"))
        d = haversine_m("lat", "lon", "plat", "plon") / 1000
        near = salted_join(a, b, ["x", "y", "z"]).withColumn("d", d).where(F.col("d") <= km)
        best = near.groupBy("site").agg(F.min_by(F.struct("point", "d"), F.struct("d", "point")).alias("m"))
        best = materialise(best.select("site", "m.point", F.col("m.d").alias("distance_km")))
        found = best if found is None else found.unionByName(best)
        left = materialise(left.join(best, "site", "left_anti"))
        if km > 20040 or left.limit(1).count() == 0:
            return found
        km *= 2


def band_energies(spectrum: DataFrame, record: Sequence[str], bands: Sequence[tuple[str, float, float]], log: bool = True) -> DataFrame:
    """Energy of fixed bands from (frequency, direction) densities, stored as base-10 logs or not.

    Needs ``edge_lo, edge_hi, direction_width, density``; a bin counts by its overlap with the band.
    """
    e = F.pow(F.lit(10.0), F.col("density")) if log else F.col("density")
    aggs = []
    for name, lo, hi in bands:
        cut = F.least("edge_hi", F.lit(hi)) - F.greatest("edge_lo", F.lit(lo))
        aggs.append(F.coalesce(F.sum(e * F.col("direction_width") * F.greatest(cut, F.lit(0.0))), F.lit(0.0)).alias(name))
    return spectrum.groupBy(*record).agg(*aggs)


def camera_assets(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Camera assets with nested feeds and products: one row per asset, products as sorted text."""
    schema = (
        "struct<data:struct<common:struct<slug:string,label:string>,properties:struct<latitude:double,longitude:double>>,"
        "feeds:array<struct<products:array<struct<data:struct<common:struct<slug:string>>>>>>>"
    )
    a = docs.select(*keep, F.from_json(text, schema).alias("a"))
    slugs = F.flatten(F.transform("a.feeds", lambda f: F.transform(f["products"], lambda p: p["data"]["common"]["slug"])))
    return a.select(
        *keep, F.col("a.data.common.slug").alias("camera"), F.col("a.data.common.label").alias("name"),
        F.col("a.data.properties.latitude").alias("lat"), F.col("a.data.properties.longitude").alias("lon"),
        F.concat_ws(",", F.array_sort(F.array_distinct(slugs))).alias("products"),
    )


def index_problems(index: DataFrame, prefix: str, name: str = "name", url: str = "url", time: str = "time_utc") -> DataFrame:
    """Counts of the four integrity rules of an image index: one row."""
    dup = index.groupBy(time).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_time"))
    rows = index.agg(
        F.count_if(~F.col(url).startswith(prefix)).alias("bad_prefix"),
        F.count_if(F.element_at(F.split(url, "/"), -1) != F.col(name)).alias("name_not_in_url"),
        F.count_if(F.col(time).isNull()).alias("no_time"),
    )
    return rows.withColumn("_1", F.lit(1)).join(dup.withColumn("_1", F.lit(1)), "_1").drop("_1")


def share(part: Column, whole: Column) -> Column:
    return divide(part.cast("double"), whole)
