"""One key holds a third of all rows or more; both plans must give the same answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions.geo import EARTH_RADIUS_M
from tidewright.operators import align, archive, conformal, crossings, metrics, qc, splits, stations
from tidewright.operators.ordered import LastKnown, Next, NextKnown, Prev, RunningSum, ordered
from tidewright.operators.quantiles import average_rank, quantiles
from tidewright.operators.skew import salted_join
from tidewright.session import table
from tidewright.sources import fields


@pytest.fixture(scope="module")
def events(spark, small):
    hot = F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id"))
    return table(spark, small, "events").withColumn("user_id", hot).cache()


def rows(df, *keys):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_ordered_specs(spark):
    rng = random.Random(1)
    data = [("a" if rng.random() < 0.5 else rng.choice("bcde"), i, rng.choice([None, i * 1.0])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    specs = dict(
        p=Prev(F.col("v")), n=Next(F.col("v")), s=RunningSum(F.col("v")), l=LastKnown(F.col("v")), x=NextKnown(F.col("v")),
        _n=RunningSum(F.lit(1)),
    )
    a = ordered(df, ["k"], ["i"], **specs)
    b = ordered(df, ["k"], ["i"], limit=20, **specs)
    assert rows(a) == rows(b)
    assert rows(ordered(df, [], ["i"], **specs)) == rows(ordered(df, [], ["i"], limit=50, **specs))


def test_looking_ahead_reads_a_key_once(spark):
    """A frame that ends with the partition is read anew for each row, which takes the square of a key's rows."""
    df = spark.range(1000).select(F.lit("a").alias("k"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    for limit in (None, 100):
        out = ordered(df, ["k"], ["id"], limit=limit, x=NextKnown(F.col("v")))
        assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert out.where(~F.col("x").eqNullSafe(F.when(F.col("id") <= 994, F.ceil(F.col("id") / 7) * 7))).count() == 0


def test_no_chunk_holds_a_hot_key(spark):
    df = spark.range(20000).withColumn("k", F.lit("a"))
    out = ordered(df, ["k"], ["id"], limit=100, s=RunningSum(F.lit(1)))
    plan = out._jdf.queryExecution().toString()
    assert "_chunk" in plan
    assert out.where("s <> id + 1").count() == 0


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
def test_as_of(events, direction):
    t = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    r = events.where("event_type = 'view'").select(F.col("event_id").alias("rid"), "user_id", F.col("ts").alias("rts"), "value")
    kw = dict(tolerance="5h", by=["user_id"], target_time="ts", reference_time="rts", direction=direction, values=["rid"], reference_tie="rid")
    assert rows(align.pair_nearest(t, r, **kw)) == rows(align.pair_nearest(t, r, limit=15, **kw))


def test_window_pairs_and_labels_against_brute_force(events):
    t = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    half = F.expr("INTERVAL 10 MINUTES")
    r = events.where("event_type = 'view'").select(
        F.col("event_id").alias("rid"), "user_id", "value", (F.col("ts") - half).alias("s"), (F.col("ts") + half).alias("e"), F.col("ts").alias("c")
    )
    kw = dict(window="4h", by=["user_id"], target_id="event_id", reference_id="rid", target_time="ts", reference_start="s", reference_end="e", values=["value"])
    got = align.pair_window(t, r, limit=10, **kw)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    brute = t.join(r, "user_id").where(F.abs(us("ts") - us("c")) <= 4 * 3600 * 1_000_000)
    assert sorted((x[0], x[1]) for x in got.select("event_id", "rid").collect()) == sorted(
        (x[0], x[1]) for x in brute.select("event_id", "rid").collect()
    )
    plain = align.pair_window(t, r, **kw)
    assert rows(plain) == rows(got)


def test_trailing_window(events):
    kw = dict(by=["user_id"], time="ts", value="value", window="2d", n_std=1.5)
    assert rows(qc.mean_std(events, **kw)) == rows(qc.mean_std(events, limit=20, **kw))


def test_quantiles_and_ranks(events):
    probs = {"a": 0.05, "b": 0.5, "c": 0.99}
    x = {r[0]: r[1:] for r in quantiles(events, ["user_id"], "value", probs).collect()}
    y = {r[0]: r[1:] for r in quantiles(events, ["user_id"], "value", probs, limit=5).collect()}
    assert x.keys() == y.keys()
    assert all(abs(p - q) < 1e-9 for k in x for p, q in zip(x[k], y[k]))
    whole = events.withColumn("v", F.floor("value"))
    a, b = average_rank(whole, [], "v", "r"), average_rank(whole, [], "v", "r", limit=10)
    assert rows(a.select("event_id", "r")) == rows(b.select("event_id", "r"))
    assert metrics.spearman(events, [], "value", "event_id").first()[0] == pytest.approx(
        metrics.spearman(events, [], "value", "event_id", limit=50).first()[0]
    )


def test_salted_join_keeps_every_row(spark):
    a = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    b = spark.range(40).select(F.when(F.col("id") < 10, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("y"))
    assert rows(a.join(b, "k")) == rows(salted_join(a, b, ["k"], limit=100))
    one = b.dropDuplicates(["k"])
    assert rows(a.join(one, "k", "left")) == rows(salted_join(a, one, ["k"], how="left", limit=100))


def test_conformal_threshold(events):
    a = conformal.threshold(events, "value", "user_id", 0.9).first()
    b = conformal.threshold(events, "value", "user_id", 0.9, limit=20).first()
    assert a["threshold"] == b["threshold"] and a["n_groups"] == b["n_groups"]
    few = events.where("user_id < 3")
    assert conformal.threshold(few, "value", "user_id", 0.99).first()["threshold"] == float("inf")


def test_grouped_split_has_one_rule(events, spark):
    plain = rows(splits.grouped_split(events, "user_id", (0.6, 0.2, 0.2)).select("event_id", "split"))
    folds = rows(splits.assign_folds(events, ["user_id"], 3).select("event_id", "cv_fold"))
    spark.conf.set("tidewright.rowsPerTask", "5")  # the group table is scanned in chunks
    try:
        out = splits.grouped_split(events, "user_id", (0.6, 0.2, 0.2))
        assert rows(out.select("event_id", "split")) == plain
        assert rows(splits.assign_folds(events, ["user_id"], 3).select("event_id", "cv_fold")) == folds
        assert out.groupBy("user_id").agg(F.count_distinct("split").alias("n")).where("n <> 1").count() == 0
        assert {r[0] for r in out.select("split").distinct().collect()} == {"train", "val", "test"}
    finally:
        spark.conf.unset("tidewright.rowsPerTask")


def test_constant_windows_pass_in_both_plans(spark):
    values = [0.3, 5.0, 1.7] + [0.1] * 110 + [0.2]
    series = spark.createDataFrame([(k, "a", v) for k, v in enumerate(values)], "i int, k string, v double")
    series = series.withColumn("t", F.timestamp_seconds(F.col("i") * 3600))
    for limit in (None, 10):
        out = qc.mean_std(series, by=["k"], time="t", value="v", window="24h", limit=limit)
        flags = {r["i"]: r["mean_std_flag"] for r in out.collect()}
        assert {flags[i] for i in range(40, 113)} == {qc.PASS} and flags[113] == qc.SUSPECT


def test_records_with_gaps_have_no_waves(spark):
    import math

    rows = [(r, float(t), None if r == "gap" and t in (13, 14) else math.sin(2 * math.pi * (t + 0.5) / 10)) for r in ("ok", "gap") for t in range(60)]
    series = spark.createDataFrame(rows, "r string, t double, v double")
    waves = crossings.zero_crossing_waves(series, ["r"], time="t", value="v")
    assert {r["r"] for r in waves.collect()} == {"ok"}
    assert [tuple(r) for r in crossings.incomplete_records(series, ["r"], "v").collect()] == [("gap", 2)]


def test_matrix_keeps_groups_without_cells(spark):
    from tidewright.operators import classify

    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 1), ("b", 99, 0), ("b", None, 0)], "g string, t int, p int")
    for k in (12, 13):
        m = classify.confusion_matrix(df, "t", "p", k, ["g"])
        assert m.count() == 2 * k * k and m.where("n > 0").collect()[0]["n"] == 2
        assert {r["g"]: r["n_out_of_range"] for r in classify.out_of_range(df, "t", "p", k, ["g"]).collect()} == {"a": 0, "b": 2}


def test_spatial_groups_against_brute_force(spark):
    import math

    rng = random.Random(5)
    pts = [(f"{i:03d}", rng.uniform(-3, 3), rng.choice([rng.uniform(-180, -177), rng.uniform(176, 180)])) for i in range(60)]
    pts += [(f"9{i:02d}", 1.0, 179.5) for i in range(20)]  # copies of one position

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    label = {p[0]: p[0] for p in pts}
    moved = True
    while moved:
        moved = False
        for a in pts:
            for b in pts:
                if km(a, b) <= 60 and label[b[0]] < label[a[0]]:
                    label[a[0]], moved = label[b[0]], True
    df = spark.createDataFrame(pts, "station_id string, lat double, lon double")
    got = {r[0]: r[1] for r in stations.spatial_groups(df, km=60, limit=10).collect()}
    assert got == {k: f"g{v}" for k, v in label.items()}


def test_collector_runs_total(events):
    starts = events.where("event_type = 'signup'").select("user_id", F.col("event_id").cast("string").alias("run"), F.col("ts").alias("started"))
    tries = events.where("event_type <> 'signup'").select("user_id", F.col("ts").alias("at"), F.lit("verified").alias("status"), "event_id")
    a = archive.collector_runs(starts, tries, ["user_id"], run="run")
    b = archive.collector_runs(starts, tries, ["user_id"], run="run", limit=25)
    assert rows(a) == rows(b)


def test_event_scores_both_plans(events):
    side = events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type")
    a, b = side.where("event_type = 'click'"), side.where("event_type = 'view'")
    x = rows(metrics.event_scores(a, b, ["user_id"], "t", 3600.0))
    assert x == rows(metrics.event_scores(a, b, ["user_id"], "t", 3600.0, limit=30))
    for r in metrics.event_scores(a, b, ["user_id"], "t", 3600.0).collect():
        p = sorted(v[0] for v in a.where(F.col("user_id") == r["user_id"]).select("t").collect())
        q = sorted(v[0] for v in b.where(F.col("user_id") == r["user_id"]).select("t").collect())
        i = j = hits = 0
        while i < len(p) and j < len(q):
            if abs(p[i] - q[j]) <= 3600:
                hits, i, j = hits + 1, i + 1, j + 1
            elif q[j] < p[i]:
                j += 1
            else:
                i += 1
        assert r["hits"] == hits
        if r["user_id"] == 7:
            break


def counted(monkeypatch, module):
    """Candidate rows of the joins that a module makes from now on, and the cells they meet in."""
    seen = []

    def joined(left, right, on, **kw):
        out = salted_join(left, right, on, **kw)
        seen.append((out.count(), right.select(*on).distinct().count()))
        return out

    monkeypatch.setattr(module, "salted_join", joined)
    return seen


def globe(n, seed):
    rng = random.Random(seed)
    return [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(n)]


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


def test_nearest_points_of_a_dense_grid(spark, monkeypatch):
    """Cells get narrower with the number of positions, and points at one position are one row."""
    seen = counted(monkeypatch, fields)
    sites, points = globe(50, 1), globe(3000, 2)
    points += [(9000 + i, *points[0][1:]) for i in range(2000)]
    out = fields.nearest_points(
        spark.createDataFrame(sites, "site int, lat double, lon double"), spark.createDataFrame(points, "point int, lat double, lon double"), start_km=3000
    )
    got = {r["site"]: (r["point"], r["distance_km"]) for r in out.collect()}
    for s in sites:
        d, p = min((metres(s, p), p[0]) for p in points)
        assert got[s[0]] == (p, pytest.approx(d / 1000))
    assert sum(n for n, _ in seen) < 5000
