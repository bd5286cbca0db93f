"""The sun's position in SQL, for the queries that need it: the public low-accuracy equations, one step a table."""

from __future__ import annotations

#: Light categories by elevation in degrees.
LIGHT_SQL = "CASE WHEN {e} >= 6 THEN 'day' WHEN {e} >= 0 THEN 'low_sun' WHEN {e} >= -6 THEN 'civil_twilight' WHEN {e} >= -12 THEN 'nautical_twilight' ELSE 'night' END"


def light_sql(elevation: str) -> str:
    return LIGHT_SQL.format(e=elevation)


def sun_ctes(source: str, out: str = "sun") -> str:
    """CTEs that add ``elevation`` and ``azimuth`` to a table with ``us, lat, lon`` and call it ``out``."""
    return f"""{out}1 AS (SELECT *, ((us / 86400e6::DOUBLE + 2440587.5::DOUBLE) - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS t FROM {source}),
    {out}2 AS (SELECT *, 280.46646::DOUBLE + t * (36000.76983 + t * 0.0003032) AS l0, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS anomaly, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS ecc,
      radians(125.04 - 1934.136 * t) AS node, 21.448 - t * (46.815 + t * (0.00059 - t * 0.001813)) AS seconds FROM {out}1),
    {out}3 AS (SELECT *, l0 - 360 * floor(l0 / 360) AS mean_long, sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * anomaly) * (0.019993 - 0.000101 * t) + sin(3 * anomaly) * 0.000289 AS centre,
      radians(23 + (26 + seconds / 60) / 60 + 0.00256 * cos(node)) AS tilt FROM {out}2),
    {out}4 AS (SELECT *, asin(sin(tilt) * sin(radians(mean_long + centre - 0.00569 - 0.00478 * sin(node)))) AS decl, power(tan(tilt / 2), 2) AS y, 2 * radians(mean_long) AS two_l FROM {out}3),
    {out}5 AS (SELECT *, (us % 86400000000) / 6e7::DOUBLE + 4 * degrees(y * sin(two_l) - 2 * ecc * sin(anomaly) + 4 * ecc * y * sin(anomaly) * cos(two_l) - 0.5 * y * y * sin(2 * two_l) - 1.25 * ecc * ecc * sin(2 * anomaly)) + 4 * lon AS minutes FROM {out}4),
    {out}6 AS (SELECT *, radians((minutes - 1440 * floor(minutes / 1440)) / 4 - 180) AS ha, radians(lat) AS phi FROM {out}5),
    {out}7 AS (SELECT *, acos(greatest(least(sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha), 1), -1)) AS zenith FROM {out}6),
    {out}8 AS (SELECT *, degrees(acos(greatest(least(CASE WHEN cos(phi) * sin(zenith) <> 0 THEN (sin(phi) * cos(zenith) - sin(decl)) / (cos(phi) * sin(zenith)) END, 1), -1))) AS a FROM {out}7),
    {out} AS (SELECT *, 90 - degrees(zenith) AS elevation, CASE WHEN ha > 0 THEN a + 180 - 360 * floor((a + 180) / 360) ELSE 540 - a - 360 * floor((540 - a) / 360) END AS azimuth FROM {out}8)"""
