"""Guards refuse what doesn't fit and name it."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import assembly, splits, suites


def test_outer_attach_checks_folds_and_keys(spark):
    inner = spark.createDataFrame([(1, "pair02"), (1, "pair12"), (2, "pair12")], "id int, pair string")
    outer = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id int, fold int, site string")
    attach = lambda o: assembly.attach_outer(inner, o, "id", pair="pair", fold="fold", keep=["site"])
    assert sorted(map(tuple, attach(outer).select("id", "pair", "site").collect())) == [(1, "pair02", "a"), (1, "pair12", "a"), (2, "pair12", "b")]
    with pytest.raises(ValueError, match="outside the folds of their pair: 1"):
        attach(outer.withColumn("fold", F.when(F.col("id") == 2, 0).otherwise(F.col("fold"))))
    with pytest.raises(ValueError, match="repeated id"):
        attach(outer.union(outer))


def test_pairs_and_wide_tables_refuse_conflicts(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.7)], "id int, site string, p double")
    b = spark.createDataFrame([(2, "y", 1.0), (3, "z", 2.0)], "id int, site string, q double")
    assert [tuple(r) for r in assembly.in_both(a, b, "id", ["site"]).select("id", "site", "p", "q").collect()] == [(2, "y", 0.7, 1.0)]
    with pytest.raises(ValueError, match="disagree on site: 1"):
        assembly.in_both(a, b.withColumn("site", F.lit("w")), "id", ["site"])
    long = spark.createDataFrame([(1, "u", 1.0), (1, "v", 2.0)], "id int, k string, v double")
    assert tuple(assembly.wide_unique(long, ["id"], "k", "v", ["u", "v"]).first()) == (1, 1.0, 2.0)
    with pytest.raises(ValueError, match="several records: 2"):
        assembly.wide_unique(long.union(long), ["id"], "k", "v", ["u", "v"])


def test_age_guard_and_days(spark):
    rows = spark.createDataFrame([("2024-01-05 12:00:00",), ("2024-01-07 00:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    now = F.lit("2024-01-08").cast("timestamp")
    assert assembly.check_age(rows, "t", now, "2d", allowed=1).count() == 2
    with pytest.raises(ValueError, match="older than 2d: 1"):
        assembly.check_age(rows, "t", now, "2d")
    days = assembly.days_between(rows.limit(1), "t", "t")
    assert [str(r[0]) for r in days.orderBy("day").collect()] == ["2024-01-04", "2024-01-05"]
    assert assembly.outside_days(rows, "t", days).count() == 1


def test_suites_need_the_provider_flag(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 8.0)], "i int, k string, h double, p double").withColumn("t", F.timestamp_seconds("i"))
    run = lambda name, **kw: suites.run(rows, suites.SUITES[name], by=["k"], time="t", height="h", period="p", tie="i", **kw)
    out, tests = run("wis")
    assert tests == ["gap_flag", "rate_flag", "range_flag", "steepness_flag"] and out.first()["qc_flag"] == 1
    with pytest.raises(ValueError):
        run("cdip")


def test_early_late_split_names_its_faults(spark):
    rows = [("g1", "train", "2020-01-01"), ("g1", "val", "2020-01-02"), (None, "test", "2022-01-01")]
    df = spark.createDataFrame(rows, "g string, r string, t string").withColumn("t", F.to_timestamp("t"))
    with pytest.raises(ValueError, match="rows without a group .1., groups with several roles .1."):
        splits.early_fit_late_test(df, "r", time="t", group="g", fit_before="2021-01-01", test_from="2021-06-01")
    with pytest.raises(ValueError, match="before the test begins"):
        splits.early_fit_late_test(df, "r", time="t", group="g", fit_before="2021-06-01", test_from="2021-06-01")
