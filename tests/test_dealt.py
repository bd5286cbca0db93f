"""Tables by key in tasks of a bounded size, ranks from one sort, blocks of hashes, cells that meet once, files of lines."""

import math
import random

from pyspark.sql import functions as F

from tidewright.functions.geo import EARTH_RADIUS_M
from tidewright.operators import archive, leakage, metrics, skew, stations
from tidewright.operators.quantiles import average_rank
from tidewright.plans import assembly as wide
from tidewright.plans.registry import Tables
from tidewright.sources import files
from tidewright.sources import stations as texts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_lines_are_dealt_by_order(spark, small, monkeypatch):
    before = sorted(wide.lines_wide(Tables(spark, small)).collect())
    monkeypatch.setattr(skew, "DEALT_ROWS", 200)
    out = wide.lines_wide(Tables(spark, small))
    assert "RepartitionByExpression" in plan(out)
    assert sorted(out.collect()) == before


def test_ranks_are_dealt_and_sorted_once(spark, monkeypatch):
    rows = [(k % 7, float(k * 31 % 11) if k % 5 else None, float(k * 17 % 13)) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    want = {}
    for g, x, _ in rows:
        if x is not None:
            same = [v for a, v, _ in rows if a == g and v is not None]
            want[g, x] = sum(v < x for v in same) + (same.count(x) + 1) / 2
    monkeypatch.setattr(skew, "DEALT_ROWS", 20)
    for limit in (None, 10):
        out = average_rank(df.where("x is not null"), ["g"], "x", "r", limit=limit)
        assert {(r["g"], r["x"]): r["r"] for r in out.collect()} == want
    assert "RepartitionByExpression" in plan(average_rank(df, ["g"], "x", "r"))
    few, hot = (archive.within_group_spearman(df, "g", "x", "y", limit=n).first() for n in (None, 10))
    assert few["n"] == hot["n"] == 240 and abs(few["rho"] - hot["rho"]) < 1e-12


def test_report_reads_its_pairs_once(spark):
    a = spark.range(300).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).cast("double").alias("y"))
    b = spark.range(300).select("id", (F.col("id") * 11 % 97).cast("double").alias("p"))
    out = metrics.regression_report(a.join(b, "id"), "y", "p", ["g"], limit=20)
    assert "Join Inner" not in plan(out)
    few = metrics.regression_report(a.join(b, "id"), "y", "p", ["g"])
    assert all(abs(x["spearman"] - y["spearman"]) < 1e-12 for x, y in zip(out.orderBy("g").collect(), few.orderBy("g").collect(), strict=True))


def test_far_hashes_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    left = [rng.getrandbits(64) for _ in range(60)]
    right = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 25))) for x in left for _ in range(3)]
    left += left[:20]
    want = {}
    for a in left:
        for b in right:
            d = bin(a ^ b).count("1")
            if d <= 17:
                key = (signed(a), signed(b), d)
                want[key] = want.get(key, 0) + 1
    sides = [spark.createDataFrame([(signed(x),) for x in s] + [(None,)], "h bigint") for s in (left, right)]
    for block, sent in ((16, 5), (10_000, 10_000)):
        monkeypatch.setattr(leakage, "BLOCK", block)
        monkeypatch.setattr(leakage, "SENT", sent)
        out = leakage.near_duplicates(*sides, "h", max_hamming=17, bands=6)
        assert "MapInArrow" in plan(out)
        assert {(r["left_hash"], r["right_hash"], r["distance"]): r["n_pairs"] for r in out.collect()} == want
    assert leakage.near_duplicates(sides[0].limit(0), sides[1], "h", max_hamming=17, bands=6).count() == 0


def test_neighbouring_cells_meet_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"s{k:03d}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(150)]
    rows += [("s000", 10.0, 179.9), ("pole", 90.0, 0.0), (None, 10.0, 10.0), ("none", None, 3.0), ("same", *rows[3][1:])]

    def km(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h))) / 1000

    known = [r for r in rows if r[0] is not None and r[1] is not None]
    df = spark.createDataFrame(rows, "station_id string, lat double, lon double")
    for crowded in (3, 2000):
        monkeypatch.setattr(stations, "CROWDED", crowded)
        for reach in (1500, 25_000):
            want = sorted((p[0], q[0], round(km(p, q), 6)) for p in known for q in known if p[0] < q[0] and km(p, q) <= reach)
            out = stations.distance_pairs(df, max_km=reach)
            assert "[-1,-1,-1]" not in plan(out)
            assert sorted((r["a"], r["b"], round(r["distance_km"], 6)) for r in out.collect()) == want


def test_lines_of_a_file_are_read_once(spark):
    head, units = "#YY MM DD hh mm WDIR", "#yr mo dy hr mn degT"
    rows = [(f, line) for f in "ab" for line in (head, units, f"2024 01 02 03 04 {ord(f)}", " ", "2024 01 02 04 04 MM")] + [("c", "2024 01 02 03 04 1"), (None, head), (None, "2024 01 02 03 04 1")]
    df = spark.createDataFrame(rows, "file string, line string")
    out = texts.with_headers(df)
    assert "Window" in plan(out) and "Join" not in plan(out)
    assert sorted((r["file"], r["n_date"], r["era"], r["has_mm"], r["units"][5]) for r in out.collect()) == [(f, 5, "yyyy_minute_units", True, "degT") for f in "aabb"]
    assert sorted((r["file"] or "", r["reason"]) for r in texts.rejected_lines(df).collect()) == [("", "no header"), ("c", "no header")]
    spark.conf.set("tidewright.rowsPerTask", "2")
    try:
        hot = texts.with_headers(df)
        assert hot.columns == out.columns and sorted(hot.collect()) == sorted(out.collect())
    finally:
        spark.conf.unset("tidewright.rowsPerTask")


def test_lines_to_a_file_for_each_top(spark, tmp_path):
    rows = [(f"s{k % 5}" if k % 5 else None, f"{k:03d}") for k in range(60)]
    df = spark.createDataFrame(rows, "top string, line string").repartition(3, "top").sortWithinPartitions("top", "line")
    folder = f"file:{tmp_path}/out"
    files.write_lines(df, folder, top="top", line="line")
    found = {p.parent.name: p.read_text().split() for p in (tmp_path / "out").rglob("*.txt")}
    names = {f"top=s{k}": k for k in range(1, 5)} | {"top=__HIVE_DEFAULT_PARTITION__": 0}
    assert found == {name: [f"{x:03d}" for x in range(k, 60, 5)] for name, k in names.items()}
    assert files.scan(spark, folder, ".txt").count() == 5
    files.write_lines(df.limit(0), f"{tmp_path}/none", top="top", line="line")
    assert files.scan(spark, f"{tmp_path}/none", ".txt").count() == 0
