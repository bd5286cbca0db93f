"""Window-mean spectra with thin coverage and depth, product tables, triples, names in several ledgers."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.functions.waves import wavenumber
from tidewright.operators import window_labels

T = datetime(2024, 5, 1, 12)
RECORD = "rid int, site string, time_utc timestamp, density array<double>, separation_hz double, direction_deg array<double>, r1 array<double>"


def label(spark, records, targets=None, **kw):
    t = spark.createDataFrame(targets or [("x", "s", T, 20.0)], "tid string, site string, time_utc timestamp, depth double")
    r = spark.createDataFrame(records, RECORD)
    out = window_labels.window_spectra(
        t, r, centers=[0.1, 0.2, 0.4], widths=[0.1, 0.1, 0.2], window="30min", by=["site"], target_id="tid", record_id="rid", bands=[("low", 0.0, 0.2), ("high", 0.2, 1.0)], depth="depth", **kw
    )
    return {x["tid"]: x for x in out.collect()}


def test_mean_of_the_window(spark):
    at = lambda m: T + timedelta(minutes=m)
    records = [
        (1, "s", at(-30), [4.0, 2.0, 0.0], 0.15, [90.0, 90.0, 90.0], [0.5, 0.5, 0.5]),
        (2, "s", at(10), [2.0, 6.0, 2.0], 0.15, [90.0, 180.0, 90.0], [1.0, 1.0, 1.0]),
        (3, "s", at(31), [9.0, 9.0, 9.0], 0.15, None, None),  # outside
        (4, "s", at(5), [1.0, None, 1.0], 0.15, None, None),  # a bin is missing
        (5, "s", at(5), [1.0, -1.0, 1.0], 0.15, None, None),
        (6, "s", at(5), [1.0, 1.0], 0.15, None, None),
        (7, "other", at(0), [9.0, 9.0, 9.0], 0.15, None, None),
    ]
    got = label(spark, records)["x"]
    mean = [3.0, 4.0, 1.0]
    e = [m * w for m, w in zip(mean, (0.1, 0.1, 0.2), strict=True)]
    assert got["n_records"] == 2 and got["offset_s"] == -600.0 and got["tp_nearest_s"] == pytest.approx(5) and got["tp_window_s"] == pytest.approx(5)
    assert got["tp_range_s"] == pytest.approx(5) and got["low_m2"] == pytest.approx(e[0]) and got["high_m2"] == pytest.approx(e[1] + e[2]) and got["bins_m2"] == pytest.approx(e)
    k = [(2 * math.pi * f) ** 2 / 9.80665 for f in (0.1, 0.2, 0.4)]
    assert got["slope"] == pytest.approx(math.sqrt(sum(a * b * b for a, b in zip(e, k, strict=True))))
    assert got["slope_low"] == pytest.approx(math.sqrt(sum(a * b * b for a, b in zip(e[:2], k[:2], strict=True))))
    (deep,) = spark.range(1).select(F.array(*[wavenumber(F.lit(f), F.lit(20.0)) for f in (0.1, 0.2, 0.4)])).first()
    assert got["slope_depth"] == pytest.approx(math.sqrt(sum(a * b * b for a, b in zip(e, deep, strict=True)))) and got["slope_depth"] > got["slope"]
    east, south = 0.2 * 0.5 + 0.4, 0.6  # measured wind energy times r, towards 90 and 180 degrees
    assert got["coverage"] == pytest.approx(1) and got["wind_r1"] == pytest.approx(math.hypot(east, south) / 1.2)
    assert got["wind_spread_deg"] == pytest.approx(math.degrees(math.sqrt(2 * (1 - got["wind_r1"]))))


@pytest.mark.parametrize("direction, separation, coverage, wind", [([90.0, 400.0, 90.0], 0.15, 0.5, False), ([90.0, 90.0, 90.0], 0.15, 1.0, True), ([90.0, 90.0, 90.0], 9.0, None, False), ([90.0, 90.0, 90.0], 0.5, None, False)])
def test_coverage_rule(spark, direction, separation, coverage, wind):
    got = label(spark, [(1, "s", T, [1.0, 2.0, 1.0], separation, direction, [0.5, 0.5, 0.5])])["x"]
    assert got["coverage"] == (None if coverage is None else pytest.approx(coverage)) and (got["wind_r1"] is not None) == wind


def test_one_record_without_a_separation_spoils_the_window(spark):
    good = (1, "s", T, [1.0, 2.0, 1.0], 0.15, [90.0] * 3, [0.5] * 3)
    assert label(spark, [good])["x"]["wind_r1"] == pytest.approx(0.5)
    assert label(spark, [good, (2, "s", T, [1.0, 2.0, 1.0], None, [90.0] * 3, [0.5] * 3)])["x"]["wind_r1"] is None


def test_targets_without_records_and_flat_spectra(spark):
    targets = [("x", "s", T, None), ("y", "none", T, 5.0), ("z", "s", None, 5.0)]
    got = label(spark, [(1, "s", T, [0.0, 0.0, 0.0], 0.15, [90.0] * 3, [0.5] * 3)], targets)
    assert got["y"]["n_records"] == 0 and got["y"]["slope"] is None and got["z"]["n_records"] == 0
    assert got["x"]["n_records"] == 1 and got["x"]["tp_nearest_s"] is None and got["x"]["tp_window_s"] is None and got["x"]["slope"] == 0 and got["x"]["slope_depth"] is None


def test_hot_site_is_split(spark):
    records = [(k, "s", T + timedelta(seconds=k), [1.0 + k % 3, 2.0, 1.0], 0.15, [90.0] * 3, [0.5] * 3) for k in range(300)]
    targets = [(f"t{k}", "s", T + timedelta(seconds=k), 5.0) for k in range(40)]
    whole, split = label(spark, records, targets), label(spark, records, targets, limit=50)
    assert all(whole[k]["bins_m2"] == pytest.approx(split[k]["bins_m2"]) and whole[k]["n_records"] == split[k]["n_records"] == 300 for k in whole)


def test_no_pairs_and_the_same_as_pairs(spark):
    """Blocks of half an hour, several records at one instant, a target that comes twice, missing sites and peaks."""
    at = lambda m: T + timedelta(minutes=m)
    records = [(k, None if k % 23 == 0 else "ab"[k % 2], at((k * 7) % 200 + (k % 5 == 0) * 0.5), [float(k % 4), float(k * k % 5), float(k % 3 > 1)], 0.15, [90.0 * k % 380] * 3, [0.5] * 3) for k in range(120)]
    targets = [(f"t{k % 50}", None if k == 7 else "ab"[k % 2], at((k * 11) % 260 - 30), 20.0) for k in range(60)]
    got = label(spark, records, targets)
    for tid in {t[0] for t in targets}:
        pairs = [((t[2] - r[2]).total_seconds(), r) for t in targets for r in records if t[0] == tid and t[1] is not None and t[1] == r[1] and abs((t[2] - r[2]).total_seconds()) <= 1800]
        x = got[tid]
        assert x["n_records"] == len(pairs)
        if not pairs:
            assert x["offset_s"] is None and x["bins_m2"] is None and x["tp_range_s"] is None
            continue
        peak = lambda r: 1 / [0.1, 0.2, 0.4][r[3].index(max(r[3]))] if max(r[3]) > 0 else None
        off, near = min(pairs, key=lambda p: (abs(p[0]), -p[0], p[1][0]))
        peaks = [peak(r) for _, r in pairs if peak(r)]
        assert x["offset_s"] == off and x["tp_nearest_s"] == (peak(near) and pytest.approx(peak(near)))
        assert x["tp_range_s"] == (pytest.approx(max(peaks) - min(peaks)) if peaks else None)
        assert x["bins_m2"] == pytest.approx([w * sum(r[3][k] for _, r in pairs) / len(pairs) for k, w in enumerate((0.1, 0.1, 0.2))])
    t = spark.createDataFrame(targets, "tid string, site string, time_utc timestamp, depth double")
    out = window_labels.window_spectra(
        t, spark.createDataFrame(records, RECORD), centers=[0.1, 0.2, 0.4], widths=[0.1, 0.1, 0.2], window="30min", by=["site"], target_id="tid", record_id="rid", bands=[("low", 0.0, 0.2)]
    )
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not [x for x in joins if "site#" in x]


def test_product_twice_is_refused(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "t int, v double")
    assert sorted(map(tuple, window_labels.product_table({"a": a, "b": a.where("t = 2")}, ["t"], "v").collect())) == [(1, 1.0, None), (2, 2.0, 2.0)]
    with pytest.raises(Exception, match="two rows of b"):
        window_labels.product_table({"a": a, "b": a.unionByName(a)}, ["t"], "v").collect()


def test_triple_reasons(spark):
    at = lambda h, m=0: datetime(2024, 5, 1, h, m)
    stamps = lambda *hours: spark.createDataFrame([("c", at(h)) for h in hours], "cam string, stamp timestamp")
    stills = [("c", "in", at(1, 20), "", 30.0), ("c", "bad", at(2, 30), "blurred", 30.0), ("c", "dark", at(3, 59), "", 1.0), ("c", "edge", at(6, 0), None, 30.0), ("c", "late", at(9, 0), "", None)]
    s = spark.createDataFrame(stills, "cam string, still string, taken timestamp, bad string, sun double")
    out = window_labels.triple_match(
        stamps(1, 2, 3, 5, 6, 7, 9), stamps(1, 2, 3, 5, 6, 8, 9), s, by=["cam"], stamp="stamp", window="1h", still_id="still", still_time="taken", excluded="bad", sun="sun", min_sun=5
    )
    got = {r["stamp"].hour: (r["still"], r["excluded_by"]) for r in out.collect()}
    assert got == {1: ("in", None), 2: ("bad", "blurred"), 3: ("dark", "low_sun"), 5: ("edge", "outside"), 6: ("edge", None), 7: ("edge", "no_second"), 8: ("late", "no_first"), 9: ("late", "low_sun")}
    assert tuple(window_labels.leg_counts(out, ["cam"]).first()) == ("c", 6, 5, 4, 2)
    none = window_labels.triple_match(stamps(1), stamps(1), s.limit(0), by=["cam"], stamp="stamp", window="1h", still_id="still", still_time="taken", excluded="bad", sun="sun", min_sun=5)
    assert none.first()["excluded_by"] == "no_still"


def test_names_on_disk_and_in_ledgers(spark):
    ledger = [
        ("https://h/a.jpg", "s1", 5, "2024-01-01", "verified", "cam.csv"), ("https://h/a.jpg", "s2", 6, "2024-01-03", "verified", "cam.host.csv"), ("https://h/a.jpg", None, None, "2024-01-09", "failed", "cam.csv"),
        ("https://h/b.jpg", None, None, "2024-01-01", "not_found", "cam.csv"), ("https://h/b.jpg", None, None, "2024-01-02", "failed", "cam.csv"), ("https://h/c.jpg", "s", 1, "2024-01-01", "verified", "cam.csv"),
    ]
    led = spark.createDataFrame(ledger, "url string, sha256 string, size_bytes int, retrieved_at string, status string, ledger string")
    disk = spark.createDataFrame([("a.jpg", "/d/a.jpg"), ("z.jpg", "/d/z.jpg")], "name string, path string")
    got = {r["name"]: r for r in window_labels.disk_and_ledgers(disk, led).collect()}
    assert set(got) == {"a.jpg", "b.jpg", "c.jpg", "z.jpg"}
    assert (got["a.jpg"]["sha256"], got["a.jpg"]["ledgers"], got["a.jpg"]["sha256_differ"]) == ("s2", "cam.csv,cam.host.csv", True)
    assert (got["b.jpg"]["status"], got["b.jpg"]["ledgers"], got["b.jpg"]["on_disk"]) == ("failed", None, False)
    assert not got["c.jpg"]["sha256_differ"] and not got["z.jpg"]["in_ledger"] and got["z.jpg"]["on_disk"]
