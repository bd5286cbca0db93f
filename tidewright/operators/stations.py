"""Station dimension: positions, distance pairs and groups chained by distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import divide
from ..functions.geo import EARTH_RADIUS_M, haversine_m
from ..session import materialise
from .quantiles import quantiles
from .skew import salted_join

#: Stations of a cell that one task compares with those of another.
CROWDED = 2_000


def _cells(lat: str, lon: str, size_m: float) -> list[Column]:
    """Cell of a point on a grid in earth-centred coordinates: no poles, no date line."""
    p, q = F.radians(lat), F.radians(lon)
    xyz = (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))
    return [F.floor(c * (EARTH_RADIUS_M / size_m)) for c in xyz]


def distance_pairs(stations: DataFrame, *, max_km: float, id_col: str = "station_id", limit=None) -> DataFrame:
    """Unordered station pairs within ``max_km``: ``a, b, distance_km``.

    A chord is never longer than its arc, so partners lie in the 27 cells around a point. Two neighbouring cells meet
    once, crowded ones in slices, and the distance is worked out for pairs whose chord is short enough.
    """
    x, y, z = _cells("lat", "lon", max_km * 1000)
    p, q = F.radians("lat"), F.radians("lon")
    unit = {"ux": F.cos(p) * F.cos(q), "uy": F.cos(p) * F.sin(q), "uz": F.sin(p)}
    base = stations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), "lat", "lon", *[c.alias(n) for n, c in unit.items()], x.alias("x"), y.alias("y"), z.alias("z")
    )
    reach = (-1, 0, 1)
    steps = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
        for i in reach for j in reach for k in reach if (i, j, k) >= (0, 0, 0)
    ])
    near, far = ({c: f"{c}{side}" for c in ("id", "lat", "lon", *unit)} for side in (1, 2))
    left = base.select("*", F.explode(steps).alias("s")).select(
        *[F.col(c).alias(n) for c, n in near.items()], *[(F.col(c) + F.col(f"s.{s}")).alias(c) for c, s in zip("xyz", "ijk", strict=True)],
        ((F.col("s.i") == 0) & (F.col("s.j") == 0) & (F.col("s.k") == 0)).alias("_own"),
    )
    right = base.select(*[F.col(c).alias(n) for c, n in far.items()], "x", "y", "z")
    # The smallest cosine, with room for rounding; half the sphere away is the farthest.
    cosine = math.cos(min(max_km * 1000 / EARTH_RADIUS_M, math.pi)) - 1e-9
    dot = sum((F.col(near[c]) * F.col(far[c]) for c in unit), F.lit(0.0))
    pairs = salted_join(left, right, ["x", "y", "z"], limit=limit or CROWDED)
    pairs = pairs.where((dot >= cosine) & (F.col("id1") != F.col("id2")) & (~F.col("_own") | (F.col("id1") < F.col("id2"))))
    turned = F.col("id1") > F.col("id2")
    first, second = ([F.when(turned, F.col(y)).otherwise(F.col(x)) for x, y in ((f"{c}{m}", f"{c}{n}") for c in ("id", "lat", "lon"))] for m, n in ((1, 2), (2, 1)))
    out = pairs.select(first[0].alias("a"), second[0].alias("b"), (haversine_m(first[1], first[2], second[1], second[2]) / 1000).alias("distance_km"))
    return out.where(F.col("distance_km") <= max_km)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the lowest id of each connected component.

    Every round takes the lowest label among a node and its neighbours and then jumps to the
    label of that label, so chains shorten geometrically. Each round is checkpointed.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("n"))
    )
    both = materialise(both)
    labels = materialise(nodes.select("id", F.col("id").alias("label")))
    while True:
        seen = salted_join(both, labels.select(F.col("id").alias("n"), F.col("label").alias("l")), ["n"], how="left")
        low = seen.groupBy("id").agg(F.min("l").alias("m"))
        step = labels.join(low, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")
        )
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = salted_join(step, jump, ["label"], how="left").select(
            "id", "old", F.least("label", F.coalesce("far", "label")).alias("label")
        )
        step = materialise(step)
        moved = step.where("old <> label").limit(1).count()
        labels = step.select("id", "label")
        if not moved:
            return labels


def spatial_groups(stations: DataFrame, *, km: float, id_col: str = "station_id", limit=None) -> DataFrame:
    """Group label ``g<lowest id>`` of stations chained by distances of at most ``km``.

    Stations sharing a small cell are certainly within ``km``; they are linked to one
    representative instead of to each other. Only representatives of distinct positions
    look for partners in neighbouring cells, and of those links one per cell pair is kept.
    """
    side = km * 1000 / math.sqrt(3) * 0.999
    x, y, z = _cells("lat", "lon", side)
    pts = stations.select(F.col(id_col).cast("string").alias("id"), "lat", "lon",
                          F.concat_ws(",", x, y, z).alias("cell"), x.alias("x"), y.alias("y"), z.alias("z"))
    heads = pts.groupBy("cell").agg(F.min("id").alias("head"))
    spots = pts.groupBy("lat", "lon", "cell", "x", "y", "z").agg(F.min("id").alias("id"))
    reach = range(-2, 3)
    steps = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
        for i in reach for j in reach for k in reach if (i, j, k) > (0, 0, 0)
    ])
    left = spots.select("cell", "lat", "lon", "x", "y", "z", F.explode(steps).alias("s")).select(
        F.col("cell").alias("ca"), F.col("lat").alias("la"), F.col("lon").alias("oa"),
        *[(F.col(c) + F.col(f"s.{s}")).alias(c) for c, s in zip("xyz", "ijk", strict=True)],
    )
    right = spots.select(F.col("cell").alias("cb"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), "x", "y", "z")
    near = salted_join(left, right, ["x", "y", "z"], limit=limit).where(
        haversine_m("la", "oa", "lb", "ob") <= km * 1000
    )
    cells = near.groupBy("ca", "cb").agg(F.lit(1).alias("_"))
    h = heads.withColumnRenamed("cell", "ca").withColumnRenamed("head", "a")
    edges = cells.join(h, "ca").join(heads.select(F.col("cell").alias("cb"), F.col("head").alias("b")), "cb").select("a", "b")
    labels = components(heads.select(F.col("head").alias("id")), edges)
    named = heads.join(labels, heads["head"] == labels["id"]).select("cell", F.concat(F.lit("g"), "label").alias("station_group"))
    return salted_join(pts.select("id", "cell"), named, ["cell"], how="left", limit=limit).select(
        F.col("id").alias(id_col), "station_group"
    )


def station_positions(listings: DataFrame, id_col: str = "station_id") -> DataFrame:
    """Median position of each station and its largest excursion from it in metres."""
    both = quantiles(listings, [id_col], "lat", {"med_lat": 0.5}).join(
        quantiles(listings, [id_col], "lon", {"med_lon": 0.5}), id_col
    )
    away = haversine_m("lat", "lon", "med_lat", "med_lon")
    return (
        salted_join(listings, both, [id_col], how="left")
        .groupBy(id_col)
        .agg(F.first("med_lat").alias("lat"), F.first("med_lon").alias("lon"), F.max(away).alias("max_move_m"),
             F.count(F.lit(1)).alias("n"))
    )


def swell_share(by: list[str], swell: str, wind: str, df: DataFrame) -> DataFrame:
    ok = F.col(swell).isNotNull() & F.col(wind).isNotNull()
    a = F.sum(F.when(ok, F.col(swell) * F.col(swell)))
    b = F.sum(F.when(ok, F.col(wind) * F.col(wind)))
    return df.groupBy(*by).agg(divide(a, a + b).alias("swell_share"))
