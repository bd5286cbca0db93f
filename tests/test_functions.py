import math

from pyspark.sql import functions as F

from tidewright.functions import angles, classes, geo, stats, waves
from tidewright.operators import leakage, spectra


def test_normal_distribution_function(spark):
    xs = [-40.0, -9.0, -3.3, -1.0, 0.0, 0.5, 2.0, 7.5, 39.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.normal_cdf("x").alias("p"))
    for r in df.collect():
        assert abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-14


def test_student_p_value():
    assert abs(stats.student_t_two_sided(2.228138851964939, 10) - 0.05) < 1e-10
    assert abs(stats.student_t_two_sided(1.0, 1) - 0.5) < 1e-12


def test_dispersion_residual(spark):
    grid = [(f / 100, h) for f in range(2, 120, 7) for h in (0.3, 2.0, 15.0, 80.0, 900.0)]
    df = spark.createDataFrame(grid, "f double, h double").withColumn("k", waves.wavenumber("f", F.col("h")))
    w2 = F.pow(2 * math.pi * F.col("f"), 2)
    worst = df.agg(F.max(F.abs(waves.G * F.col("k") * F.tanh(F.col("k") * F.col("h")) - w2) / w2)).first()[0]
    assert worst < 1e-12


def test_group_velocity_limits(spark):
    df = spark.createDataFrame([(0.1, 5000.0, 1.0)], "f double, deep double, shallow double")
    r = df.select(waves.group_velocity("f", F.col("deep")).alias("d"), waves.group_velocity("f").alias("inf"),
                  waves.group_velocity(F.lit(0.005), F.col("shallow")).alias("s")).first()
    assert abs(r["d"] - r["inf"]) < 1e-9 and abs(r["s"] - math.sqrt(9.80665)) < 5e-3


def test_solar_noon_and_midnight(spark):
    df = spark.createDataFrame([("2024-03-20 12:07:00",), ("2024-06-21 00:00:00",)], "t string")
    e, a = geo.solar_position(F.to_timestamp("t"), F.lit(0.0), F.lit(0.0))
    noon, night = df.select(e.alias("e"), a.alias("a")).collect()
    assert noon["e"] > 89.5 and night["e"] < -60


def test_circular(spark):
    df = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (0.0, 180.0)], "a double, b double")
    d = [r[0] for r in df.select(angles.angular_difference("a", "b")).collect()]
    assert d == [20.0, -20.0, 180.0]
    m = df.where("b <> 180").agg(angles.circular_mean("a")).first()[0]
    assert min(m, 360 - m) < 1e-9


def test_class_edges(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (2.5,), (2.6,), (float("nan"),)], "v double")
    r = [x[0] for x in df.select(classes.right_closed_class("v")).collect()]
    assert r == [0, 1, 2, 3, -1]
    assert [x[0] for x in df.select(classes.left_closed_bin("v", (0.5, 2.5, 3.0))).collect()] == [0, 0, 1, 1, -1]


def jonswap_table(spark, gamma=3.3):
    df = spark.range(1, 500).select(F.lit("r").alias("r"), (F.col("id") * 0.002).alias("frequency_hz"))
    return df.withColumns(
        {"bandwidth_hz": F.lit(0.002), "spectral_density_m2_hz": waves.jonswap("frequency_hz", F.lit(2.0), F.lit(10.0), gamma)}
    )


def test_bulk_recovers_jonswap(spark):
    r = spectra.bulk_parameters(jonswap_table(spark), ["r"]).first()
    assert abs(r["Hm0"] - 2.0) < 0.1 and abs(r["Tp"] - 10) < 0.15 and abs(r["Tp_smooth"] - 10) < 0.3


def test_missing_bin_voids_the_moment(spark):
    s = jonswap_table(spark).withColumn(
        "spectral_density_m2_hz", F.when(F.col("frequency_hz") < 0.5, F.col("spectral_density_m2_hz"))
    )
    assert spectra.moments(s, ["r"], {"m0": 0}).first()["m0"] is None
    assert spectra.moments(s, ["r"], {"m0": 0}, fmax=0.4).first()["m0"] > 0.2


def test_regrid_conserves_energy(spark):
    s = jonswap_table(spark)
    edged = s.withColumns({"edge_lo": F.col("frequency_hz") - 0.001, "edge_hi": F.col("frequency_hz") + 0.001})
    edges = [0.001 + 0.0415 * i for i in range(25)]
    g = spectra.regrid(edged.where("edge_hi <= 0.9975"), ["r"], edges[:24])
    a = g.agg(F.sum(F.col("spectral_density_m2_hz") * (F.col("edge_hi") - F.col("edge_lo")))).first()[0]
    lo, hi = edges[0], edges[23]
    cut = F.least("edge_hi", F.lit(hi)) - F.greatest("edge_lo", F.lit(lo))
    b = edged.agg(F.sum(F.col("spectral_density_m2_hz") * F.greatest(cut, F.lit(0.0)))).first()[0]
    assert abs(a - b) < 1e-9


def test_mem_distribution_is_positive_and_normalised(spark):
    r1, r2 = 0.8, 0.45
    df = spark.createDataFrame([(40.0, 40.0, r1, r2)], "alpha1 double, alpha2 double, r1 double, r2 double")
    d = spectra.directional_distribution(df, list(range(0, 360, 5)), "mem").first()["distribution"]
    assert min(d) >= 0 and abs(sum(d) * 2 * math.pi / 72 - 1) < 1e-9
    # Symmetric about the mean direction.
    assert all(abs(d[(8 + i) % 72] - d[(8 - i) % 72]) < 1e-9 for i in range(36))


def test_hamming_join_against_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    left = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {}
    for a in left:
        for b in base:
            d = bin(a ^ b).count("1")
            if d <= 4:
                want[(signed(a), signed(b))] = want.get((signed(a), signed(b)), 0) + 1
    dl = spark.createDataFrame([(signed(a),) for a in left], "h bigint")
    dr = spark.createDataFrame([(signed(b),) for b in base], "h bigint")
    for bands in (1, 2, 3, 5):
        if bands == 1:
            continue
        got = leakage.near_duplicates(dl, dr, "h", max_hamming=4, bands=bands, limit=20).collect()
        assert {(r["left_hash"], r["right_hash"]): r["n_pairs"] for r in got} == want


def test_regrid_adds_up_records_before_bins_are_rows(spark):
    rows = [(k % 3, 0.1 * (k // 3), 0.1 * (k // 3) + 0.1, None if k == 4 else float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "r int, edge_lo double, edge_hi double, spectral_density_m2_hz double")
    out = spectra.regrid(df, ["r"], [0.0, 0.25, 0.5, 1.5])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and "Generate" not in plan[plan.index("Aggregate") :]
    got = {(r["r"], r["edge_lo"]): r["spectral_density_m2_hz"] for r in out.collect()}
    for (r, lo), d in got.items():
        hi = {0.0: 0.25, 0.25: 0.5, 0.5: 1.5}[lo]
        parts = [(x, min(b, hi) - max(a, lo)) for own, a, b, x in rows if own == r and min(b, hi) > max(a, lo)]
        gap = hi > 1.0 or any(x is None for x, _ in parts)
        assert (d is None) == gap and (gap or abs(d - sum(x * w for x, w in parts) / (hi - lo)) < 1e-9)
    assert len(got) == 9
