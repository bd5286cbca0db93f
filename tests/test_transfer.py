"""Weights carried to held-out folds: rows are read once for all arms, and odd rows count as they always did."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import blends, corrections, quantiles, skew

KEYS = {"sample": "sid", "group": "g", "fold": "fold", "pair": "pair", "observed": "obs", "forecast": "fc", "disagreement": "dis"}
ARMS = {"one": ["fc"], "two": ["fc", "dis"]}


def outer_rows(spark):
    rows = [(i, f"g{i}", i % 3, 1.0 + i * 0.7, 1.0 + i * 7 % 11, i * 5 % 13 - 5.5, f"2020-01-{i + 1:02d}") for i in range(24)]
    return spark.createDataFrame(rows, "sid int, g string, fold int, obs double, fc double, dis double, t string")


def inner_rows(outer):
    wide = outer.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(3)]))).where("k <> fold")
    pair = F.concat(F.lit("pair"), F.least("k", "fold").cast("string"), F.greatest("k", "fold").cast("string"))
    return wide.withColumn("pair", pair).drop("k", "t")


def test_cuts_are_made_once_for_all_arms(spark, monkeypatch):
    asked = []
    made = blends.quantiles_of
    monkeypatch.setattr(blends, "quantiles_of", lambda df, by, wanted, **kw: asked.append(list(wanted)) or made(df, by, wanted, **kw))
    outer = outer_rows(spark)
    rows, _ = corrections.transfer(inner_rows(outer), outer, ARMS, **KEYS)
    assert asked == [["fc", "dis"]]
    cal = inner_rows(outer).withColumn("fold", sum(F.substring("pair", i, 1).cast("int") for i in (5, 6)) - F.col("fold"))
    for arm, features in ARMS.items():  # as each arm by itself
        w = blends.reliability_weights(cal, ["fold"], "obs", "fc", "dis", features)
        alone = blends.apply_reliability(outer, w, ["fold"], "fc", "dis", features)
        own = {r["sid"]: (r["reliability"], r["constant_blend"]) for r in alone.collect()}
        got = {r["sid"]: (r[arm], r["constant"]) for r in rows.collect()}
        assert got.keys() == own.keys() and all(got[k] == pytest.approx(own[k], abs=1e-12) for k in own)


def test_the_calibration_is_kept_once(spark, monkeypatch):
    kept = []
    keep = corrections.materialise
    monkeypatch.setattr(corrections, "materialise", lambda df: kept.append(keep(df)) or kept[-1])
    outer = outer_rows(spark)
    corrections.transfer(inner_rows(outer), outer, ARMS, time="t", early_end="2020-01-15", later_start="2020-01-10", **KEYS)
    assert [df.count() for df in kept].count(48) == 1 and 28 not in [df.count() for df in kept]  # 28 rows are early


def test_totals_of_a_hot_group_are_not_counted_again(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 101 / 7).alias("v"))
    want = {r["k"]: r["q"] for r in quantiles.quantiles(df, ["k"], "v", {"q": 0.3}).collect()}
    counted = []
    monkeypatch.setattr(skew, "_hot_keys", lambda *a: counted.append(a))
    spark.conf.set("tidewright.rowsPerTask", "50")
    try:
        got = {r["k"]: r["q"] for r in quantiles.quantiles(df, ["k"], "v", {"q": 0.3}).collect()}
    finally:
        spark.conf.unset("tidewright.rowsPerTask")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert not counted


def test_rows_that_repeat_or_miss_count_as_before(spark):
    outer = outer_rows(spark)
    inner, twice = inner_rows(outer), outer.unionByName(outer.where("sid in (3, 4, 9)"))
    times = {"time": "t", "early_end": "2020-01-15", "later_start": "2020-01-10"}
    counts = lambda *a, **kw: sorted((r["fold"], r["calibration_rows"], r["calibration_groups"], r["test_rows"], r["test_groups"]) for r in corrections.transfer(*a, {"one": ["fc"]}, **KEYS, **kw)[1].collect())
    # An outer row that repeats weighs in the calibration only where the times are joined to it.
    assert counts(inner, twice) == [(0, 16, 16, 10, 8), (1, 16, 16, 9, 8), (2, 16, 16, 8, 8)]
    assert counts(inner, twice, **times) == [(0, 10, 9, 6, 5), (1, 11, 9, 5, 5), (2, 13, 10, 5, 5)]
    for i, o, fault in (
        (inner_rows(twice), outer, "samples twice in a calibration: 6; folds without all other samples: 3"),
        (inner_rows(twice), twice, "samples twice in a calibration: 6; folds without all other samples: 3"),
        (inner, outer.where("sid <> 3"), "samples that don't belong: 2; folds without all other samples: 2"),
        (inner.withColumn("sid", F.when(F.col("sid") != 5, F.col("sid"))), outer, "samples that don't belong: 2"),
    ):
        with pytest.raises(ValueError, match=fault):
            corrections.transfer(i, o, {"one": ["fc"]}, **KEYS, **times)
