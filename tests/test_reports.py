"""Reports by stratum, packages, corrections, inventory and providers on small literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import classes, clips
from tidewright.operators import assembly, corrections, inventory, packages, reports, splits
from tidewright.sources import listings, providers, stations


def scores(true, pred, k):
    c = np.zeros((k, k))
    for a, p in zip(true, pred, strict=True):
        c[a, p] += 1
    sup, pre, n = c.sum(1), c.sum(0), c.sum()
    d = np.subtract.outer(np.arange(k), np.arange(k)) ** 2
    chance = (d * np.outer(sup, pre)).sum() / n
    seen = sup + pre > 0
    return {
        "accuracy": np.trace(c) / n,
        "balanced_accuracy": np.mean([c[i, i] / sup[i] for i in range(k) if sup[i]]),
        "f1_macro": np.mean([2 * c[i, i] / (sup[i] + pre[i]) for i in range(k) if seen[i]]),
        "quadratic_weighted_kappa": 1 - (d * c).sum() / chance,
        "within_one_accuracy": c[np.sqrt(d) <= 1].sum() / n,
    }


def test_class_report_equals_plain_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i % 9}", int(a), int(a if rng.random() < 0.6 else rng.integers(0, 3)), i % 4 == 0) for i, a in enumerate(rng.integers(0, 3, 200))]
    df = spark.createDataFrame([*rows, ("d1", -1, 2, False), ("d2", 1, -1, False), ("d3", None, 1, False)], "day string, a int, p int, near boolean")
    out = reports.class_report(df, "a", "p", 3, unit="day", near="near", replicates=50).first()
    assert (out["n"], out["n_units"], out["n_clear"]) == (200, 9, 150)
    assert out["coverage"] == pytest.approx(200 / 201) and sum(out["confusion"]) == 200
    for name, value in scores([r[1] for r in rows], [r[2] for r in rows], 3).items():
        assert out[name] == pytest.approx(value) and out[f"{name}_lo"] <= out[name] <= out[f"{name}_hi"]
    clear = [r for r in rows if not r[3]]
    for name, value in scores([r[1] for r in clear], [r[2] for r in clear], 3).items():
        assert out[f"{name}_clear"] == pytest.approx(value)


def test_class_report_without_predictions_keeps_the_stratum(spark):
    df = spark.createDataFrame([("x", "d", 1, -1), ("y", "d", 1, 1), ("y", None, 0, 1)], "s string, day string, a int, p int")
    out = {r["s"]: r for r in reports.class_report(df, "a", "p", 2, unit="day", by=["s"], replicates=5).collect()}
    assert out["x"]["n"] == 0 and out["x"]["accuracy"] is None and out["x"]["coverage"] == 0
    assert out["y"]["n_units"] == 2 and out["y"]["accuracy"] == 0.5
    assert reports.class_report(df.limit(0), "a", "p", 2, unit="day", by=["s"], replicates=5).count() == 0


def test_contrast_of_a_better_arm_is_met_and_of_itself_is_not(spark):
    df = spark.range(300).select((F.col("id") % 12).alias("u"), F.col("id").cast("double").alias("y"), (F.col("id") + 1.0).alias("good"), (F.col("id") + 3.0 + F.col("id") % 2).alias("bad"))
    out = {r["control"]: r for r in reports.contrasts(df, "y", "good", ["bad", "good"], unit="u", replicates=40).collect()}
    assert out["bad"]["met"] and out["bad"]["delta"] == pytest.approx(1 - np.sqrt((9 + 16) / 2))
    assert not out["good"]["met"] and out["good"]["delta"] == 0 and out["good"]["units"] == 12


def test_registered_comparison_refuses_gaps_and_repeats(spark):
    df = spark.createDataFrame([(1, "g", 1.0, 1.0, 2.0), (1, "g", 2.0, None, 2.0)], "id int, g string, y double, a double, b double")
    with pytest.raises(ValueError, match="more than once"):
        reports.registered_comparison(df, "id", "y", ["a", "b"], "a", ["b"], group="g", station="g", replicates=5)


def test_column_named_label_survives_a_split(spark):
    df = spark.createDataFrame([(i, f"g{i % 5}", float(i)) for i in range(50)], "id int, g string, label double")
    out = splits.grouped_split(df, "g", output="split_a")
    assert out.columns == ["id", "g", "label", "split_a"] and out.agg(F.sum("label")).first()[0] == sum(range(50))


def test_unknown_protocol_and_unmet_windows_are_refused(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError, match="unknown protocol"):
        packages.protocol_split(df, {"protocol": "none"})
    cut = lambda when, met: spark.createDataFrame([(when, met)], "until_utc string, rule_met boolean")
    window = lambda a, b: packages.closed_window(a, b, registered="2024-01-05", earliest="2024-01-08", days=14)
    row = window(cut("2024-01-09 16:00:00", True), cut("2024-01-24 00:00:00", True)).first()
    assert (row["start"].day, row["end"].day) == (10, 24)
    for a, b, text in (
        (cut("2024-01-09", False), cut("2024-02-01", True), "complete"), (cut("2024-01-04", True), cut("2024-02-01", True), "registered end"),
        (cut("2024-01-09", True), cut("2024-01-20", True), "cover"),
    ):
        with pytest.raises(ValueError, match=text):
            window(a, b)


def test_residual_ridge_keeps_the_nowcast_without_a_model(spark):
    rows = [("a", ["train", "val", "test"][i % 3], float(i), 2.0 * i + 1) for i in range(30)] + [("b", "test", 1.0, 5.0), ("a", "test", None, 7.0)]
    df = spark.createDataFrame(rows, "cam string, role string, x double, y double").withColumn("now", F.lit(4.0))
    out = corrections.residual_ridge(df, ["x"], "y", nowcast="now", train_nowcast="now", role="role", by=["cam"], alphas=[1e-6, 100.0]).collect()
    assert [r["prediction"] for r in out if r["cam"] == "b" or r["x"] is None] == [4.0, 4.0]
    assert all(r["alpha"] == 1e-6 and abs(r["prediction"] - r["y"]) < 1e-3 for r in out if r["cam"] == "a" and r["x"] is not None)


def test_band_corrections_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x, prior = rng.normal(size=60), rng.uniform(0.5, 2, 60)
    true = prior * np.exp(0.3 * x + 0.1 * np.log(prior))
    df = spark.createDataFrame([(i, float(x[i]), float(prior[i]), float(true[i])) for i in range(60)], "id int, x double, p double, t double")
    train = F.col("id") < 40
    out = corrections.band_corrections(df, {"one": ("t", "p")}, ["x"], row_id="id", complete=F.lit(True), train=train, test=~train, alpha=1e-9)
    got = {r["id"]: r["corrected"] for r in out.collect()}
    assert set(got) == set(range(40, 60)) and all(got[i] == pytest.approx(true[i], rel=1e-6) for i in got)


def test_transfer_refuses_a_fold_that_saw_itself(spark):
    outer = spark.createDataFrame([(i, f"g{i}", i % 2, 1.0 + i, 1.0, 0.5 + i) for i in range(8)], "sid int, g string, fold int, obs double, fc double, dis double")
    inner = outer.withColumn("pair", F.lit("pair01"))
    kw = {"sample": "sid", "group": "g", "fold": "fold", "pair": "pair", "observed": "obs", "forecast": "fc", "disagreement": "dis"}
    rows, folds = corrections.transfer(inner, outer, {"cells": ["fc"]}, **kw)
    assert rows.count() == 8 and all(0 <= r["weight_cells"] <= 1 for r in rows.collect())
    assert [(r["calibration_rows"], r["test_rows"]) for r in folds.collect()] == [(4, 4), (4, 4)]
    with pytest.raises(ValueError, match="without all other samples"):
        corrections.transfer(inner.where("sid <> 3"), outer, {"cells": ["fc"]}, **kw)
    with pytest.raises(ValueError, match="groups on both sides"):
        corrections.transfer(inner.withColumn("g", F.lit("g0")), outer, {"cells": ["fc"]}, **kw)


def test_references_sets_and_hours_that_are_not_there_are_refused(spark):
    refs = spark.createDataFrame([("s", 0.0, 0.0, "x1", None, None, None)], "site_id string, site_lat double, site_lon double, station_id string, name string, lat double, lon double")
    known = spark.createDataFrame([("X1", "one", 0.0, 1.0)], "station_id string, name string, lat double, lon double")
    assert inventory.resolve_references(refs, known).first()["distance_km"] == 111.2
    with pytest.raises(ValueError, match="without a position"):
        inventory.resolve_references(refs, known.limit(0))
    names = spark.createDataFrame([("l", 0, "b"), ("l", 1, "@s"), ("l", 2, "c")], "list string, position int, name string")
    sets = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "set string, position int, camera string")
    got = inventory.expand_sets(names, sets).orderBy("position", "place").collect()
    assert [r["camera"] for r in got] == ["b", "a", "c"]
    with pytest.raises(ValueError, match="unknown sets"):
        inventory.expand_sets(names, sets.limit(0)).count()
    hourly = spark.createDataFrame([("2024-01-01 00:00:00", 1.0)] * 2, "hour string, v double")
    with pytest.raises(ValueError, match="listed twice"):
        inventory.attach_previous_hour(spark.createDataFrame([("2024-01-01 01:30:00",)], "t string"), "t", hourly, "hour")


def test_first_header_counts_and_other_lines_are_listed(spark, tmp_path):
    (tmp_path / "a1.txt").write_text("#YY MM DD hh mm WVHT DPD\n#yr mo dy hr mn m sec\n2024 01 02 03 04 1.5 8.0\n2024 13 02 03 04 1.5 8.0\nYYYY MM DD hh GST\n2024 01 02 04 04 2.5 MM\n")
    (tmp_path / "b2.txt").write_text("2024 01 02 03 04 1.5\n")
    out = providers.ingest(providers.StationFiles(), spark, str(tmp_path), "stdmet")
    got = sorted((r["station_id"], r["variable"], r["value"]) for r in out.observations.collect())
    assert got == [("A1", "wave_peak_period", 8.0), ("A1", "wave_significant_height", 1.5), ("A1", "wave_significant_height", 2.5)]
    assert sorted(r["reason"] for r in out.rejects.collect()) == ["bad time", "no header"]
    assert out.violations.count() == 0 and out.flags.where("range_flag = 1").count() == 2
    found = providers.StationFiles().discover(spark, str(tmp_path))
    assert sorted((r["station_id"], r["product"], r["archive"]) for r in found.collect()) == [("A1", "stdmet", "realtime"), ("B2", "stdmet", "realtime")]
    places = [r["line"] for r in stations.read_lines(spark, str(tmp_path), "a1.txt").orderBy("place").collect()]
    assert places[0].startswith("#YY") and places[-1].endswith("MM")


def test_windows_stay_inside_the_clip(spark):
    rows = [(100.0, 0, None, 0), (10.0, 1, 0, 1), (1000.0, 20, 19, 20), (320.0, 40, 10, 16), (64.0, 40, 2, 11)]
    df = spark.createDataFrame([(s, k) for s, k, _, _ in rows], "s double, k int").withColumn("mid", clips.midpoint_window("s", "k"))
    first, end = clips.centred_windows("mid", "k")
    got = df.select("s", "k", "mid", first.alias("first"), end.alias("end")).collect()
    assert [(r["s"], r["k"], r["mid"]) for r in got] == [r[:3] for r in rows]
    inside = [r for r in got if r["mid"] is not None]
    assert [r["end"] for r in inside] == [r[3] for r in rows[1:]] and all(0 <= r["first"] <= r["mid"] < r["end"] <= r["k"] for r in inside)


def test_published_classes_leave_gaps_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "h double")
    got = df.select(classes.gap_class("h", 1.5, 3.0).alias("g"), classes.scaled_class("h", 0.5, [0.75, 1.25, 2.0]).alias("s")).collect()
    assert [r["g"] for r in got] == [0, None, 1, None, None] and [r["s"] for r in got] == [None, 0, None, None, None]


def test_bulletin_about_another_place_is_refused(spark):
    docs = spark.createDataFrame([("a/gfswave.S1.bull", " Location : S2\n"), ("a/gfswave.S3.bull.idx", " Location : S9\n")], "path string, doc string")
    with pytest.raises(ValueError, match="another place"):
        listings.selected_bulletins(docs, "doc", "path", ["S1", "S3"])
    assert listings.selected_bulletins(docs, "doc", "path", ["S3"]).count() == 0


def test_age_guard_refuses_what_it_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-03-01 00:00:00",), (None,)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    now = F.lit("2024-03-31 00:00:00").cast("timestamp")
    row = assembly.age_counts(df, "t", now, "60d").first()
    assert (row["rows"], row["too_old"], row["youngest_days"]) == (3, 1, 30.0)
    assert assembly.check_age(df, "t", now, "60d", allowed=1).count() == 3
    with pytest.raises(ValueError, match="older than 60d"):
        assembly.check_age(df, "t", now, "60d")
