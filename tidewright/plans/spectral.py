"""Queries of the spectral operators: an order is a record, its line numbers are frequency bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles, waves
from ..operators import crossings, qc, spectra
from .registry import Tables, query, r6, rounded, sql_r6

REC = ["l_orderkey"]
# A fixed 7-bin grid; the third bin is missing in every eleventh order.
SQL_SPECTRA = """
WITH raw AS (SELECT l_orderkey, l_linenumber AS k, sum(l_quantity) AS q, min(l_discount) AS d, min(l_tax) AS x,
               min(l_extendedprice) AS pr FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_orderkey, k, CAST(0.05 AS DOUBLE) * k AS f, CAST(0.05 AS DOUBLE) AS w, CASE WHEN k = 3 AND l_orderkey % 11 = 0 THEN NULL ELSE q END AS s,
        pr % 360 AS a1, (pr * 3) % 360 AS a2, d * 5 AS r1, x * 3 AS r2 FROM raw)"""


def spectra_of_orders(t: Tables) -> DataFrame:
    raw = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(
        F.sum("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_tax").alias("x"),
        F.min("l_extendedprice").alias("pr"),
    )
    gap = (F.col("k") == 3) & (F.col("l_orderkey") % 11 == 0)
    return raw.select(
        "l_orderkey",
        "k",
        (0.05 * F.col("k")).alias("frequency_hz"),
        F.lit(0.05).alias("bandwidth_hz"),
        F.when(~gap, F.col("q")).alias("spectral_density_m2_hz"),
        (F.col("pr") % 360).alias("alpha1"),
        ((F.col("pr") * 3) % 360).alias("alpha2"),
        (F.col("d") * 5).alias("r1"),
        (F.col("x") * 3).alias("r2"),
    )


@query(
    "spectral_moments",
    f"""{SQL_SPECTRA} SELECT l_orderkey,
      CASE WHEN count(s) = count(*) THEN {sql_r6('sum(s * w)')} END AS m0,
      CASE WHEN count(s) = count(*) THEN {sql_r6('sum(f * s * w)')} END AS m1,
      CASE WHEN count(s) = count(*) THEN {sql_r6('sum(f * f * s * w)')} END AS m2,
      CASE WHEN count(s) = count(*) THEN {sql_r6('sum(s * w / f)')} END AS m_1
    FROM s WHERE f >= 0.08 AND f <= 0.33 GROUP BY l_orderkey""",
)
def spectral_moments(t: Tables) -> DataFrame:
    out = spectra.moments(spectra_of_orders(t), REC, {"m0": 0, "m1": 1, "m2": 2, "m_1": -1}, 0.08, 0.33)
    return rounded(out, "m0", "m1", "m2", "m_1")


@query(
    "spectral_moments_missing_as_zero",
    f"{SQL_SPECTRA} SELECT l_orderkey, {sql_r6('coalesce(sum(s * w), 0)')} AS m0 FROM s GROUP BY l_orderkey",
)
def spectral_moments_missing_as_zero(t: Tables) -> DataFrame:
    return rounded(spectra.moments(spectra_of_orders(t), REC, {"m0": 0}, missing="zero"), "m0")


SQL_BULK = f"""{SQL_SPECTRA},
g AS (SELECT l_orderkey, count(s) = count(*) AS whole,
  sum(s * w) AS m0, sum(f * s * w) AS m1, sum(f * f * s * w) AS m2, sum(s * w / f) AS mm, max(s) AS smax,
  sum(power(coalesce(s, 0), 4) * f * w) AS s4f, sum(power(coalesce(s, 0), 4) * w) AS s4,
  sum(coalesce(s, 0) * coalesce(s, 0) * f * w) AS s2f,
  arg_min({{f: f, a: a1, r: r1}}, (coalesce(-s, 1e300), f)) AS pk,
  sum(coalesce(s, 0) * w * r1 * cos(radians(a1))) / nullif(sum(coalesce(s, 0) * w), 0) AS ca,
  sum(coalesce(s, 0) * w * r1 * sin(radians(a1))) / nullif(sum(coalesce(s, 0) * w), 0) AS cb
  FROM s GROUP BY l_orderkey),
h AS (SELECT *, CASE WHEN whole THEN m0 END AS n0, CASE WHEN whole THEN m1 END AS n1, CASE WHEN whole THEN m2 END AS n2,
  CASE WHEN whole THEN mm END AS nm, CASE WHEN smax > 0 THEN 1 / pk.f END AS tp, degrees(atan2(cb, ca)) AS dm FROM g)"""


@query(
    "bulk_wave_parameters",
    f"""{SQL_BULK} SELECT l_orderkey, {sql_r6('n0')} AS m0, {sql_r6('4 * sqrt(n0)')} AS "Hm0", {sql_r6('tp')} AS "Tp",
      {sql_r6('s4 / nullif(s4f, 0)')} AS "Tp_smooth", {sql_r6('n0 / nullif(n1, 0)')} AS "Tm01",
      {sql_r6('sqrt(n0 / nullif(n2, 0))')} AS "Tm02", {sql_r6('nm / nullif(n0, 0)')} AS "Tm_10",
      {sql_r6("2 * s2f / nullif(n0 * n0, 0)")} AS "Qp",
      {sql_r6('2 * pi() * 4 * sqrt(n0) / (9.80665 * tp * tp)')} AS steepness_p, {sql_r6('pk.a')} AS "Dp",
      {sql_r6('CASE WHEN dm < 0 THEN dm + 360 ELSE dm END')} AS "Dm",
      {sql_r6('degrees(sqrt(2 * (1 - sqrt(ca * ca + cb * cb))))')} AS spread_m,
      {sql_r6('degrees(sqrt(2 * (1 - pk.r)))')} AS spread_p
    FROM h""",
)
def bulk_wave_parameters(t: Tables) -> DataFrame:
    out = spectra.bulk_parameters(spectra_of_orders(t), REC, directional=True).drop("nu")
    return rounded(out, *[c for c in out.columns if c != "l_orderkey"])


@query(
    "spectral_width",
    f"""{SQL_BULK} SELECT l_orderkey, {sql_r6('sqrt(n0 * n2 / (n1 * n1) - 1)', 4)} AS nu FROM h
    WHERE n0 * n2 / (n1 * n1) - 1 > 1e-6""",
)
def spectral_width(t: Tables) -> DataFrame:
    out = spectra.bulk_parameters(spectra_of_orders(t), REC).where("nu * nu > 1e-6")
    return out.select("l_orderkey", r6("nu", 4).alias("nu"))


SQL_EDGES = f"""{SQL_SPECTRA}, n AS (SELECT l_orderkey, f, s, lag(f) OVER w AS p, lead(f) OVER w AS q FROM s
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY f)),
e AS (SELECT l_orderkey, f, s, coalesce((f + p) / 2, greatest(f - ((q + f) / 2 - f), 0)) AS lo,
        coalesce((q + f) / 2, f + (f - (f + p) / 2)) AS hi FROM n)"""


@query(
    "frequency_bin_edges",
    f"""{SQL_EDGES} SELECT l_orderkey, {sql_r6('f')} AS frequency_hz, {sql_r6('lo')} AS edge_lo, {sql_r6('hi')} AS edge_hi,
      {sql_r6('hi - lo')} AS bandwidth_hz FROM e""",
)
def frequency_bin_edges(t: Tables) -> DataFrame:
    grids = spectra_of_orders(t).select("l_orderkey", "frequency_hz")
    return rounded(spectra.bin_edges(grids, REC), "frequency_hz", "edge_lo", "edge_hi", "bandwidth_hz")


EDGES = [0.025, 0.125, 0.2, 0.225, 0.375, 0.45]


@query(
    "regrid_energy_conserving",
    f"""{SQL_EDGES}, b AS (SELECT * FROM (VALUES (0.025, 0.125), (0.125, 0.2), (0.2, 0.225), (0.225, 0.375),
        (0.375, 0.45)) v(bl, bh)),
    b1 AS (SELECT CAST(bl AS DOUBLE) AS bl, CAST(bh AS DOUBLE) AS bh FROM b),
    x AS (SELECT l_orderkey, bl, bh, s, lo, hi, greatest(least(hi, bh) - greatest(lo, bl), 0) AS o FROM e, b1),
    g AS (SELECT l_orderkey, bl, bh, sum(s * o) AS en, count(*) FILTER (s IS NULL AND o > 0) AS gaps,
            min(lo) AS slo, max(hi) AS shi FROM x WHERE lo IS NOT NULL AND hi IS NOT NULL GROUP BY 1, 2, 3)
    SELECT l_orderkey, bl AS edge_lo, bh AS edge_hi, {sql_r6('CASE WHEN bl >= slo - 1e-12 AND bh <= shi + 1e-12 AND gaps = 0 THEN en / (bh - bl) END')}
      AS spectral_density_m2_hz FROM g""",
)
def regrid_energy_conserving(t: Tables) -> DataFrame:
    """Orders with one line only have no edges and stay out, as a one-bin grid has no width."""
    s = spectra_of_orders(t).select("l_orderkey", "frequency_hz", "spectral_density_m2_hz")
    edged = spectra.bin_edges(s, REC).where("edge_lo is not null and edge_hi is not null")
    return rounded(spectra.regrid(edged, REC, EDGES), "spectral_density_m2_hz")


@query(
    "mean_square_slope",
    f"""{SQL_SPECTRA} SELECT l_orderkey, {sql_r6('coalesce(sum(s * w), 0)')} AS m0,
      {sql_r6('coalesce(sum(s * power(power(2 * pi() * f, 2) / 9.80665, 2) * w), 0)')} AS mss FROM s GROUP BY 1""",
)
def mean_square_slope(t: Tables) -> DataFrame:
    return rounded(spectra.mean_square_slope(spectra_of_orders(t), REC), "m0", "mss")


@query(
    "low_frequency_energy",
    f"""{SQL_SPECTRA}, g AS (SELECT l_orderkey, coalesce(sum(s * w) FILTER (f < 0.18), 0) AS e, count(s) AS n FROM s
      GROUP BY 1) SELECT l_orderkey, {sql_r6('e')} AS low_energy,
      CAST(CASE WHEN n = 0 THEN 9 WHEN e < 0.5 OR e > 4 THEN 3 ELSE 1 END AS TINYINT) AS flag FROM g""",
)
def low_frequency_energy(t: Tables) -> DataFrame:
    return rounded(qc.low_frequency_energy(spectra_of_orders(t), REC, 0.18, (0.5, 4.0)), "low_energy")


@query(
    "spectra_by_grid",
    """WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS grid FROM lineitem GROUP BY 1)
    SELECT len(grid) AS n_bins, count(*) AS n_records FROM g GROUP BY grid""",
)
def spectra_by_grid(t: Tables) -> DataFrame:
    """Records that share one frequency grid, found by an order-free fingerprint."""
    ids = spectra.grid_id(spectra_of_orders(t), REC)
    return ids.groupBy("grid_id", "n_bins").agg(F.count(F.lit(1)).alias("n_records")).drop("grid_id")


DIRECTIONS = [float(d) for d in range(0, 360, 60)]


def _spread_sql(body: str) -> str:
    return f"""{SQL_SPECTRA}, th AS (SELECT unnest(generate_series(0, 300, 60)) AS deg),
    c AS (SELECT l_orderkey, k, r1 * cos(radians(a1)) AS x1, r1 * sin(radians(a1)) AS y1,
            r2 * cos(2 * radians(a2)) AS x2, r2 * sin(2 * radians(a2)) AS y2 FROM s),
    {body}
    n AS (SELECT l_orderkey, k, deg, d / (sum(d) OVER (PARTITION BY l_orderkey, k) * 2 * pi() / 6) AS d FROM d0)
    SELECT l_orderkey, k, deg AS direction_deg, {sql_r6('d', 5)} AS d FROM n"""


def _spread(t: Tables, method: str) -> DataFrame:
    # posexplode would add a filter on the array and push its whole expression down a second time.
    out = spectra.directional_distribution(spectra_of_orders(t), DIRECTIONS, method)
    return out.select("l_orderkey", "k", F.posexplode_outer("distribution").alias("i", "d")).select(
        "l_orderkey", "k", (F.col("i") * 60).cast("bigint").alias("direction_deg"), r6("d", 5).alias("d")
    )


@query(
    "directional_distribution_fourier",
    _spread_sql("""d0 AS (SELECT l_orderkey, k, deg, (1 + 2 * (x1 * cos(radians(deg)) + y1 * sin(radians(deg))
      + x2 * cos(2 * radians(deg)) + y2 * sin(2 * radians(deg)))) / (2 * pi()) AS d FROM c, th),"""),
)
def directional_distribution_fourier(t: Tables) -> DataFrame:
    return _spread(t, "fourier")


@query(
    "directional_distribution_mem",
    _spread_sql("""p AS (SELECT *, (x1 - (x2 * x1 + y2 * y1)) / (1 - (x1 * x1 + y1 * y1)) AS pr,
        (y1 - (y2 * x1 - x2 * y1)) / (1 - (x1 * x1 + y1 * y1)) AS pi1 FROM c),
    q AS (SELECT *, x2 - (x1 * pr - y1 * pi1) AS qr, y2 - (x1 * pi1 + y1 * pr) AS qi FROM p),
    d0 AS (SELECT l_orderkey, k, deg, (1 - (pr * x1 + pi1 * y1) - (qr * x2 + qi * y2)) / (2 * pi() * (
        power(1 - (pr * cos(radians(deg)) + pi1 * sin(radians(deg)))
                - (qr * cos(2 * radians(deg)) + qi * sin(2 * radians(deg))), 2)
      + power((pi1 * cos(radians(deg)) - pr * sin(radians(deg)))
                + (qi * cos(2 * radians(deg)) - qr * sin(2 * radians(deg))), 2))) AS d FROM q, th),"""),
)
def directional_distribution_mem(t: Tables) -> DataFrame:
    return _spread(t, "mem")


@query(
    "fourier_round_trip",
    f"""{SQL_SPECTRA} SELECT l_orderkey, k, {sql_r6('r1 * cos(radians(a1))')} AS a1, {sql_r6('r1 * sin(radians(a1))')} AS b1,
      {sql_r6('r2 * cos(2 * radians(a2))')} AS a2, {sql_r6('r2 * sin(2 * radians(a2))')} AS b2, {sql_r6('r1', 5)} AS r1_back
    FROM s""",
)
def fourier_round_trip(t: Tables) -> DataFrame:
    s = spectra_of_orders(t)
    a1, b1, a2, b2 = angles.fourier_from_polar("alpha1", "alpha2", "r1", "r2")
    _, _, r1, _ = angles.polar_from_fourier(a1, b1, a2, b2)
    return s.select(
        "l_orderkey", "k", r6(a1).alias("a1"), r6(b1).alias("b1"), r6(a2).alias("a2"), r6(b2).alias("b2"),
        r6(r1, 5).alias("r1_back"),
    )


@query(
    "directional_spectrum_moments",
    f"""WITH d AS (SELECT l_suppkey AS rec, l_linenumber AS k, CAST(l_quantity AS INT) % 12 * 30 AS deg,
        sum(l_extendedprice) / 1e5 AS e FROM lineitem GROUP BY 1, 2, 3),
    g AS (SELECT rec, k, sum(e * radians(30)) AS s,
        sum(e * radians(30) * cos(radians(deg + 180))) AS a1, sum(e * radians(30) * sin(radians(deg + 180))) AS b1
        FROM d GROUP BY 1, 2)
    SELECT rec, {sql_r6('0.05 * k')} AS frequency_hz, {sql_r6('s')} AS spectral_density_m2_hz,
      {sql_r6('CASE WHEN atan2(b1 / s, a1 / s) < 0 THEN degrees(atan2(b1 / s, a1 / s)) + 360 ELSE degrees(atan2(b1 / s, a1 / s)) END', 5)} AS alpha1,
      {sql_r6('sqrt(a1 * a1 + b1 * b1) / s')} AS r1 FROM g""",
)
def directional_spectrum_moments(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy(
        F.col("l_suppkey").alias("rec"), (0.05 * F.col("l_linenumber")).alias("frequency_hz"),
        (F.col("l_quantity").cast("int") % 12 * 30).alias("direction_deg"),
    ).agg((F.sum("l_extendedprice") / 1e5).alias("energy"))
    out = rounded(spectra.circular_moments_2d(d, ["rec"], 30.0), "frequency_hz", "spectral_density_m2_hz", "r1")
    return rounded(out, "alpha1", digits=5).drop("alpha2", "r2")


SQL_ETA = """
WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, avg(value) AS v FROM events GROUP BY 1, 2),
z AS (SELECT e.user_id, t, v - avg(v) OVER (PARTITION BY user_id) AS eta FROM e),
l AS (SELECT *, lag(eta) OVER w AS pe, lag(t) OVER w AS pt FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT *, coalesce(pe < 0 AND eta >= 0, FALSE) AS hit FROM l),
n AS (SELECT *, CASE WHEN hit THEN pt + pe / (pe - eta) * (t - pt) END AS st,
        sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS wave FROM c),
w AS (SELECT user_id, wave, max(st) AS start_s, max(eta) AS hi, min(eta) AS lo FROM n WHERE wave > 0 GROUP BY 1, 2),
f AS (SELECT *, lead(start_s) OVER (PARTITION BY user_id ORDER BY wave) AS fin FROM w),
waves AS (SELECT user_id, wave, start_s, fin - start_s AS period, greatest(hi, 0) AS crest, greatest(-lo, 0) AS trough,
            greatest(hi, 0) + greatest(-lo, 0) AS height FROM f WHERE fin IS NOT NULL)"""


def elevation(t: Tables) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.groupBy("user_id", seconds.alias("t")).agg(F.avg("value").alias("v"))


def waves_of_users(t: Tables) -> DataFrame:
    return crossings.zero_crossing_waves(elevation(t), ["user_id"], time="t", value="v")


@query(
    "zero_crossing_waves",
    f"""{SQL_ETA} SELECT user_id, CAST(wave AS BIGINT) AS wave, {sql_r6('start_s', 3)} AS start_s,
      {sql_r6('period', 3)} AS period, {sql_r6('crest')} AS crest, {sql_r6('trough')} AS trough,
      {sql_r6('height')} AS height FROM waves""",
)
def zero_crossing_waves(t: Tables) -> DataFrame:
    out = rounded(waves_of_users(t), "start_s", "period", digits=3)
    return rounded(out, "crest", "trough", "height")


@query(
    "zero_crossing_summary",
    f"""{SQL_ETA}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY height DESC, wave) AS k,
        count(*) OVER (PARTITION BY user_id) AS n FROM waves)
    SELECT user_id, count(*) AS n_waves, {sql_r6('avg(height) FILTER (k <= floor(n * (1.0::DOUBLE / 3)))')} AS h_one_third,
      {sql_r6('avg(height) FILTER (k <= floor(n * 0.1::DOUBLE))')} AS h_one_tenth, {sql_r6('max(height)')} AS h_max,
      {sql_r6('avg(height)')} AS h_mean, {sql_r6('sqrt(avg(height * height))')} AS h_rms, {sql_r6('avg(period)', 3)} AS t_z,
      {sql_r6('avg(period) FILTER (k <= floor(n * (1.0::DOUBLE / 3)))', 3)} AS t_one_third,
      {sql_r6('arg_min(period, k)', 3)} AS t_h_max FROM r GROUP BY user_id""",
)
def zero_crossing_summary(t: Tables) -> DataFrame:
    out = crossings.wave_summary(waves_of_users(t), ["user_id"])
    out = rounded(out, "h_one_third", "h_one_tenth", "h_max", "h_mean", "h_rms")
    return rounded(out, "t_z", "t_one_third", "t_h_max", digits=3)


@query(
    "crossing_table_statistics",
    f"""WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value,
        CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS flag FROM events),
    a AS (SELECT *, CASE WHEN n % 2 = 1 THEN value ELSE -value END AS peak, n * 1.0 AS b0, n + 1.0 AS b1,
        value / 10 + 0.1 AS height, 4 + value / 100 AS period FROM x),
    q AS (SELECT *, lead(peak) OVER w AS qp, lead(b0) OVER w AS q0, lead(flag) OVER w AS qf FROM a
          WINDOW w AS (PARTITION BY user_id ORDER BY n)),
    k AS (SELECT *, peak > 0 AND qp < 0 AND qp > -100 AND abs(b1 - q0) < 0.002 AND height > 0 AND height <= 40
            AND period > 0 AS ok FROM q),
    g AS (SELECT user_id, height, period, row_number() OVER (PARTITION BY user_id ORDER BY height DESC, n) AS r,
            count(*) OVER (PARTITION BY user_id) AS c FROM k WHERE ok AND flag = 1 AND qf = 1),
    s AS (SELECT user_id, count(*) AS c, avg(height) AS hm, avg(height) FILTER (r <= floor((c + 2) / 3)) AS h3,
            avg(period) AS tz FROM g GROUP BY user_id)
    SELECT u.user_id, coalesce(s.c, 0) AS good_wave_count, CASE WHEN s.c >= 5 THEN {sql_r6('s.hm')} END AS good_mean_height_m,
      CASE WHEN s.c >= 5 THEN {sql_r6('s.h3')} END AS good_h_third_m, CASE WHEN s.c >= 5 THEN {sql_r6('s.tz')} END AS good_tz_s
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON u.user_id = s.user_id""",
)
def crossing_table_statistics(t: Tables) -> DataFrame:
    from ..operators.ordered import ordered, position

    flag = F.when(F.col("event_type") == "error", 2).otherwise(1)
    x = ordered(t.events.select("user_id", "event_id", "value", flag.alias("flag")), ["user_id"], ["event_id"], n=position())
    table = x.select(
        "user_id", "n", F.col("n").cast("double").alias("bound_start"), (F.col("n") + 1.0).alias("bound_end"),
        F.when(F.col("n") % 2 == 1, F.col("value")).otherwise(-F.col("value")).alias("peak"),
        (F.col("value") / 10 + 0.1).alias("height"), (4 + F.col("value") / 100).alias("period"), "flag",
    )
    out = crossings.crossing_statistics(table, ["user_id"], order="n", min_waves=5)
    names = ["good_mean_height_m", "good_h_third_m", "good_tz_s"]
    return rounded(out, *names).select("user_id", "good_wave_count", *names)


@query(
    "energy_period",
    f"""SELECT l_orderkey, {sql_r6('sum(l_quantity / (0.05 * l_linenumber)) / sum(l_quantity)')} AS energy_period_s
    FROM lineitem GROUP BY 1""",
)
def energy_period(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", (0.05 * F.col("l_linenumber")).alias("frequency_hz"), F.col("l_quantity").alias("energy")
    )
    return rounded(crossings.energy_period(rows, REC), "energy_period_s")


@query(
    "wave_theory",
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice,
      {sql_r6('power(2 * pi() * (0.05 * l_linenumber), 2) / 9.80665')} AS k_deep,
      {sql_r6('9.80665 * power(l_quantity, 2) / (2 * pi())')} AS length_deep,
      {sql_r6('0.02 / sqrt((l_discount + 0.1) / (9.80665 * power(l_quantity, 2) / (2 * pi())))')} AS iribarren,
      0.0 AS residual FROM lineitem""",
)
def wave_theory(t: Tables) -> DataFrame:
    """Finite-depth k is checked through the residual of the dispersion relation."""
    f, h = 0.05 * F.col("l_linenumber"), F.col("l_quantity") + 1.0
    k = waves.wavenumber(f, h)
    w2 = F.pow(2 * waves.PI * f, 2)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", k.alias("k"))
    residual = F.abs(waves.G * F.col("k") * F.tanh(F.col("k") * h) - w2) / w2
    return li.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", r6(waves.wavenumber(f)).alias("k_deep"),
        r6(waves.deep_water_length("l_quantity")).alias("length_deep"),
        r6(waves.iribarren(F.lit(0.02), F.col("l_discount") + 0.1, "l_quantity")).alias("iribarren"),
        r6(residual).alias("residual"),
    )


@query(
    "parametric_spectra",
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice,
      {sql_r6('5.0 / 16 * power(2.0, 2) * power(1 / 8.0, 4) * power(0.05 * l_linenumber, -5) * exp(-1.25 * power(1 / 8.0 / (0.05 * l_linenumber), 4))')} AS pm
    FROM lineitem""",
)
def parametric_spectra(t: Tables) -> DataFrame:
    f = 0.05 * F.col("l_linenumber")
    pm = waves.pierson_moskowitz(f, F.lit(2.0), F.lit(8.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", r6(pm).alias("pm"))
