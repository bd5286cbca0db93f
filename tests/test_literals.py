"""Small literal cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import align, archive, blends, crossings, qc
from tidewright.sources.stations import merge_snapshots

P, NE, S, X, M = 1, 2, 3, 4, 9
BASE = 1_704_067_200  # 2024-01-01


def series(spark, values, hours=None):
    hours = hours or list(range(len(values)))
    rows = [("a", i, BASE + int(h * 3600), v) for i, (h, v) in enumerate(zip(hours, values))]
    df = spark.createDataFrame(rows, "k string, i int, s bigint, v double")
    return df.withColumn("t", F.timestamp_seconds("s"))


def flags(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_flag_precedence(spark):
    rows = list(zip([P, P, NE, S, P, NE], [NE, S, NE, X, M, P]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a int, b int")
    assert flags(df.withColumn("f", qc.combine("a", "b")), "f") == [P, S, NE, X, M, P]


def test_gross_range(spark):
    df = series(spark, [0.5, 30.0, 0.01, float("nan"), 12.0])
    out = df.withColumn("f", qc.gross_range("v", (0, 25), (0.05, 10)))
    assert flags(out, "f") == [P, X, S, M, S]


@pytest.mark.parametrize("limit", [None, 3])
def test_flat_line(spark, limit):
    df = series(spark, [1.0] * 5 + [2.0] + [0.0] * 5)
    out = qc.flat_line(df, by=["k"], time="t", value="v", tie="i", limit=limit)
    assert flags(out, "flat_flag") == [P, P, S, S, X, P, P, P, S, S, S]


@pytest.mark.parametrize("limit", [None, 2])
def test_rate_and_gap(spark, limit):
    df = series(spark, [1.0, 1.5, 4.0, 4.1], [0, 1, 4, 4])
    out = qc.gap_and_rate(df, by=["k"], time="t", value="v", tie="i", expected_s=3600, max_change=2.0, limit=limit)
    assert flags(out, "rate_flag") == [P, P, X, P]
    assert flags(out, "gap_flag") == [P, P, S, X]


def test_nearest_pair(spark):
    t = spark.createDataFrame([(0, "2024-01-01 11:10:00"), (1, "2024-01-01 12:10:00"), (2, "2024-01-01 20:00:00")], "i int, t string")
    r = spark.createDataFrame([("2024-01-01 10:40:00", 1.0), ("2024-01-01 11:40:00", 2.0)], "t string, v double")
    t, r = (d.withColumn("t", F.to_timestamp("t")) for d in (t, r))
    out = align.pair_nearest(
        t, r, tolerance="45min", target_time="t", reference_time="t", suspect_offset="20min", values=["v"]
    ).orderBy("i").collect()
    assert [x["sync_qc_flag"] for x in out] == [S, S, M]
    assert out[0]["time_offset_s"] == 1800 and out[0]["v_ref"] == 1.0  # a tie goes to the earlier


def test_overlap(spark):
    t = spark.createDataFrame([(0, "2024-01-01 00:05:00", "2024-01-01 00:08:00")], "i int, a string, b string")
    r = spark.createDataFrame(
        [(0, "2024-01-01 00:00:00", "2024-01-01 00:20:00"), (1, "2024-01-01 00:30:00", "2024-01-01 00:50:00")],
        "j int, a string, b string",
    )
    t, r = (d.withColumns({"a": F.to_timestamp("a"), "b": F.to_timestamp("b")}) for d in (t, r))
    out = align.pair_overlap(
        t, r, bucket="20min", target_id="i", reference_id="j", target_span=("a", "b"), reference_span=("a", "b")
    ).collect()
    assert [(x["overlap_fraction"], x["center_offset_s"]) for x in out] == [(1.0, -210.0)]


def test_window_pair_ranks(spark):
    t = spark.createDataFrame([(0, "2024-01-01 00:55:00")], "i int, t string").withColumn("t", F.to_timestamp("t"))
    starts = [(0, "2024-01-01 00:03:20"), (1, "2024-01-01 00:33:20"), (2, "2024-01-01 01:03:20")]
    r = spark.createDataFrame(starts, "j int, s string").withColumn("s", F.to_timestamp("s"))
    r = r.withColumn("e", F.col("s") + F.expr("INTERVAL 20 MINUTES"))
    out = align.pair_window(
        t, r, window="45min", target_id="i", reference_id="j", target_time="t", reference_start="s", reference_end="e"
    ).orderBy("j").collect()
    assert [x["offset_s"] for x in out] == [2500, 700, -1100]
    assert [x["rank"] for x in out] == [2, 0, 1]


def test_snapshot_merge(spark):
    rows = [("s", 1, "a", 2.1, None), ("s", 1, "b", 2.3, None), ("s", 1, "c", None, 7.0), ("s", 2, "a", 1.0, 5.0)]
    df = spark.createDataFrame(rows, "st string, t int, snapshot string, hs double, tp double")
    out = merge_snapshots(df, ["st", "t"], ["hs", "tp"], "hs").orderBy("t").collect()
    assert (out[0]["hs"], out[0]["tp"], out[0]["n_snapshots"], out[0]["snapshots_disagree"]) == (2.3, 7.0, 3, True)
    assert (out[1]["hs"], out[1]["n_snapshots"], out[1]["snapshots_disagree"]) == (1.0, 1, False)


def test_coverage_code(spark):
    ts = F.to_timestamp
    cal = spark.createDataFrame([("s", f"2024-01-01 {h:02d}:00:00") for h in range(7, 13)], "station_id string, h string")
    cal = cal.select("station_id", ts("h").alias("hour"))
    cal = cal.withColumn("active_from", F.lit("2024-01-01 08:00:00").cast("timestamp"))
    cal = cal.withColumn("active_until", F.lit(None).cast("timestamp"))

    def at(*times):
        return spark.createDataFrame([("s", f"2024-01-01 {x}") for x in times], "station_id string, t string").select(
            "station_id", ts("t").alias("time_utc")
        )

    out = archive.coverage_codes(
        cal, at("07:05:00", "08:10:00", "11:12:00"), at("09:30:00"), F.lit("2024-01-01 12:30:00").cast("timestamp")
    )
    assert "".join(r["code"] for r in out.orderBy("hour").collect()) == "01x?1."
    assert archive.coverage_strings(out).first()["coverage"] == "01x?1."


def test_reliability_weights_recover_a_known_share(spark):
    df = spark.range(900).select(
        F.lit(0).alias("fold"), (F.col("id") % 30 * 0.1).alias("fc"), ((F.col("id") * 7 % 31) * 0.1 - 1.5).alias("d")
    )
    df = df.withColumn("obs", F.col("fc") + 0.25 * F.col("d"))
    w = blends.reliability_weights(df, ["fold"], "obs", "fc", "d", ["fc", "d"]).collect()
    assert len(w) == 9 and all(abs(r["weight"] - 0.25) < 1e-9 and abs(r["constant"] - 0.25) < 1e-9 for r in w)


@pytest.mark.parametrize("limit", [None, 7])
def test_individual_waves(spark, limit):
    rows = [
        ("r", i, i * 1.0, i + 1.0, 1.0 if i % 2 == 0 else -1.0, 3.0, 2.0, 2 if i == 10 else 1) for i in range(50)
    ]
    df = spark.createDataFrame(
        rows, "r string, n int, bound_start double, bound_end double, peak double, height double, period double, flag int"
    )
    out = crossings.crossing_statistics(df, ["r"], order="n", limit=limit).first()
    assert (out["good_wave_count"], out["incl_unevaluated_wave_count"]) == (24, 25)
    assert (out["good_mean_height_m"], out["good_tz_s"], out["good_h_third_m"]) == (3.0, 2.0, 3.0)


@pytest.mark.parametrize("limit", [None, 40])
def test_zero_crossing_of_a_sine(spark, limit):
    df = spark.range(1000).select(
        F.lit("a").alias("r"), (F.col("id") / 10).alias("t"), F.sin(2 * math.pi * F.col("id") / 10 / 8 + 0.3).alias("v")
    )
    w = crossings.zero_crossing_waves(df, ["r"], time="t", value="v", how="none", limit=limit)
    out = crossings.wave_summary(w, ["r"], limit=limit).first()
    assert abs(out["t_z"] - 8) < 1e-3 and abs(out["h_mean"] - 2) < 1e-2 and out["n_waves"] == 11
