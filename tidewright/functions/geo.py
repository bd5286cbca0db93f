"""Positions on the sphere and the position of the sun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import wrap180
from .base import DAY_US, ColumnLike, clip, col, micros

# Fixed value: mean Earth radius in metres (IUGG).
EARTH_RADIUS_M = 6371008.8


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = (p2 - p1) / 2
    half_lon = F.radians(col(lon2) - col(lon1)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def initial_bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Bearing from the first point to the second, clockwise from north."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2) - col(lon1))
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def wrap_longitude(lon: ColumnLike) -> Column:
    return wrap180(lon)


def solar_position(time: ColumnLike, lat: ColumnLike, lon: ColumnLike) -> tuple[Column, Column]:
    """Elevation and azimuth in degrees by the public NOAA low-accuracy solar equations.

    Elevation is geometric (no refraction). ``time`` is a timestamp in a UTC session.
    """
    us = micros(time)
    days = us / float(DAY_US)
    # Julian centuries since J2000; 2440587.5 is the Julian day of the epoch.
    t = ((days + 2440587.5) - 2451545.0) / 36525.0
    mean_long = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    anomaly = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    ecc = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = (
        F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t))
        + F.sin(2 * anomaly) * (0.019993 - 0.000101 * t)
        + F.sin(3 * anomaly) * 0.000289
    )
    node = F.radians(125.04 - 1934.136 * t)
    apparent = F.radians(mean_long + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt_seconds = 21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))
    tilt = F.radians(23 + (26 + tilt_seconds / 60) / 60 + 0.00256 * F.cos(node))
    decl = F.asin(F.sin(tilt) * F.sin(apparent))

    y = F.pow(F.tan(tilt / 2), 2)
    two_l = 2 * F.radians(mean_long)
    equation = 4 * F.degrees(
        y * F.sin(two_l)
        - 2 * ecc * F.sin(anomaly)
        + 4 * ecc * y * F.sin(anomaly) * F.cos(two_l)
        - 0.5 * y * y * F.sin(2 * two_l)
        - 1.25 * ecc * ecc * F.sin(2 * anomaly)
    )
    minutes = F.pmod(us, F.lit(DAY_US)) / 6e7
    true_minutes = F.pmod(minutes + equation + 4 * col(lon), F.lit(1440.0))
    hour_angle = F.radians(true_minutes / 4 - 180)

    phi = F.radians(col(lat))
    cos_zenith = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour_angle)
    zenith = F.acos(clip(cos_zenith, -1.0, 1.0))
    elevation = 90.0 - F.degrees(zenith)
    across = F.cos(phi) * F.sin(zenith)
    ratio = F.when(across != 0, (F.sin(phi) * F.cos(zenith) - F.sin(decl)) / across)
    az = F.degrees(F.acos(clip(ratio, -1.0, 1.0)))
    azimuth = F.when(hour_angle > 0, F.pmod(az + 180, F.lit(360.0))).otherwise(
        F.pmod(540 - az, F.lit(360.0))
    )
    return elevation, azimuth


def illumination(elevation: ColumnLike) -> Column:
    """day, low_sun, civil_twilight, nautical_twilight or night."""
    e = col(elevation)
    return (
        F.when(e >= 6, "day")
        .when(e >= 0, "low_sun")
        .when(e >= -6, "civil_twilight")
        .when(e >= -12, "nautical_twilight")
        .otherwise("night")
    )


def glint_risk(elevation, azimuth, camera_azimuth: float, field_of_view: float, max_elevation=35.0):
    """A low sun inside the camera's horizontal field of view."""
    e = col(elevation)
    off_axis = F.abs(wrap180(col(azimuth) - camera_azimuth))
    return (e > 0) & (e < max_elevation) & (off_axis <= field_of_view / 2)
