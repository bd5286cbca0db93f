"""Correctors, wide ridge, user metrics and audits against plain versions on small data."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions.stats import seeded_hash
from tidewright.operators import adapt, bootstrap, images, leakage, metrics, multi_ridge, user_metrics


def hashes(spark, rows, *columns):
    """The library's draw numbers, so that plain versions can repeat the draws."""
    df = spark.createDataFrame(rows, [f"c{k}" for k in range(len(rows[0]))])
    return {tuple(r[:-1]): r[-1] for r in df.select("*", seeded_hash(0, *[f"c{k}" for k in columns])).collect()}


# ------------------------------------------------------------------ corrector
@pytest.mark.parametrize("curved", [True, False])
def test_corrector_chooses_on_validation(spark, curved):
    """Steps are for trees, a plane is for ridge."""
    rnd = random.Random(1)
    rows = []
    for k in range(600):
        a, b = rnd.uniform(-1, 1), rnd.uniform(-1, 1)
        y = (3.0 if a * b > 0 else -3.0) if curved else 2 * a - b
        rows.append((k, k % 10, ["test", "val", "train", "train", "train"][k % 5], a, b if k != 7 else None, y))
    df = spark.createDataFrame(rows, "id int, grp int, split string, a double, b double, y double")
    out = adapt.forecast_corrector(df, ["a", "b"], "y", ["split"], key=["id"], group="grp", boost={"maxIter": 20, "maxDepth": 4, "stepSize": 0.3}).collect()
    assert {r["id"] for r in out} == {k for k in range(600) if k % 5 == 0}
    assert {r["arm"] for r in out} == {"boost" if curved else "ridge"}
    assert (out[0]["val_rmse_boost"] < out[0]["val_rmse_ridge"]) == curved
    error = math.sqrt(sum((r["prediction"] - r["observed"]) ** 2 for r in out) / len(out))
    assert error < (0.6 * out[0]["val_rmse_ridge"] if curved else 0.2)


def test_corrector_refuses_crossing_groups_and_empty_roles(spark):
    rows = [(k, k % 3, ["train", "val", "test"][k % 3], 1.0 * k, 1.0) for k in range(30)]
    df = spark.createDataFrame(rows, "id int, grp int, split string, x double, y double")
    with pytest.raises(ValueError, match="more than one role"):
        adapt.check_roles(df.withColumn("grp", F.lit(1)), "grp", ["split"], "y")
    with pytest.raises(ValueError, match="no row to val"):
        adapt.check_roles(df.where("split <> 'val'"), "grp", ["split"], "y")


# ------------------------------------------------------------------ few shots
def test_few_shot_curve_equals_every_draw(spark):
    rnd = random.Random(4)
    rows = []
    for site in range(6):
        for k in range(rnd.randint(4, 30)):
            y = rnd.uniform(0.01, 3)
            rows.append((f"s{site}", f"{site}-{k}", k < 5, k >= 6, y, math.log(y * (1 + site / 5)) + rnd.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "site string, id string, early boolean, late boolean, y double, lp double")
    ks, lams, n_draws = [1, 2, 5], [0.0, 3.0], 3
    numbers = hashes(spark, [(d, r[1]) for d in range(n_draws) for r in rows], 0, 1)
    want = {}
    for k in ks:
        for lam in lams:
            total = n = sites = before = 0
            for site in sorted({r[0] for r in rows}):
                window = [r for r in rows if r[0] == site and r[2]]
                late = [r for r in rows if r[0] == site and r[3]]
                if len(window) < k or len(late) < 2:
                    continue
                sites, n = sites + 1, n + len(late)
                before += sum((math.exp(r[5]) - r[4]) ** 2 for r in late)
                for d in range(n_draws):
                    picked = sorted(window, key=lambda r: (numbers[(d, r[1])], r[1]))[:k]
                    b = sum(math.log(max(r[4], 0.05)) - r[5] for r in picked) / (k + lam)
                    total += sum((math.exp(r[5] + b) - r[4]) ** 2 for r in late) / n_draws
            want[k, lam] = (sites, n, math.sqrt(total / n), math.sqrt(before / n))
    curve = adapt.few_shot_curve(df, site="site", row_id="id", window="early", evaluate="late", observed="y", log_prediction="lp", ks=ks, shrinkage=lams, n_draws=n_draws, min_eval=2)
    got = {(r["k"], r["lam"]): (r["n_sites"], r["n_rows"], r["rmse"], r["rmse_before"]) for r in curve.collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-9) for x in want)
    best = adapt.best_shrinkage(curve).first()
    mean = {lam: sum(want[k, lam][2] for k in ks) / 3 for lam in lams}
    assert best["lam"] == min(lams, key=lambda x: (mean[x], x)) and best["mean_rmse"] == pytest.approx(min(mean.values()))


# ------------------------------------------------------------------ wide ridge
def test_wide_ridge_equals_numpy(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.withColumn("y", F.array(F.col("x")[0] + 1e6, F.col("x")[1] * F.col("x")[2], F.lit(3.0))).withColumn("part", F.col("vec_id") % 2)
    out = multi_ridge.predict(rows, multi_ridge.fit(rows, "x", 64, "y", 3, by="part", penalty=2.0), "x", by="part").collect()
    for part in (0, 1):
        own = [r for r in out if r["part"] == part]
        x, y = np.array([r["x"] for r in own]), np.array([r["y"] for r in own])
        mean, sd = x.mean(0), x.std(0)
        z = (x - mean) / np.where(sd < 1e-8, 1, sd)
        w = np.linalg.solve(z.T @ z + 2 * np.eye(64), z.T @ (y - y.mean(0)))
        assert np.allclose([r["predictions"] for r in own], z @ w + y.mean(0), rtol=1e-9, atol=1e-6)


def test_wide_ridge_leaves_out_incomplete_rows_and_many_groups(spark):
    rows = [(k % 300, [1.0 * k, 5.0], [2.0 * k]) for k in range(3000)] + [(0, [None, 1.0], [1.0]), (0, [float("nan"), 1.0], [1.0]), (0, [1.0], [1.0]), (0, None, [1.0])]
    df = spark.createDataFrame(rows, "g int, x array<double>, y array<double>")
    models = multi_ridge.fit(df, "x", 2, "y", 1, by="g", penalty=0.001)
    assert models.count() == 300
    out = multi_ridge.predict(df, models, "x", by="g").where("g = 0 and size(x) = 2 and x[0] is not null and not isnan(x[0])").collect()
    assert len(out) == 10 and all(r["predictions"][0] == pytest.approx(r["y"][0], rel=1e-3, abs=1) for r in out)
    whole = multi_ridge.fit(df, "x", 2, "y", 1, penalty=0.001)
    assert multi_ridge.predict(df.limit(1), whole, "x").first()["predictions"][0] == pytest.approx(0, abs=1)


# ------------------------------------------------------------------ user metrics
def median_error():
    """Median absolute error to a hundredth: a state of counts, not of sums. (A class of a function is sent by value.)"""

    class MedianError:
        def add(self, y, p):
            return np.bincount(np.minimum((np.abs(p - y) * 100).astype(int), 999), minlength=1000)

        def merge(self, states, times):
            return (states * times[:, None]).sum(0)

        def finish(self, state):
            return float(np.searchsorted(np.cumsum(state), state.sum() / 2) / 100)

    return MedianError()


def test_user_metric_equals_plain_resampling(spark):
    rnd = random.Random(8)
    rows = [(f"g{k % 13:02d}", rnd.uniform(0, 5), rnd.uniform(0, 5)) for k in range(700)] + [("g00", None, 1.0), ("g01", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double").repartition(5)
    groups = sorted({r[0] for r in rows})
    reps, k = 60, len(groups)
    numbers = hashes(spark, [(r, d) for r in range(reps) for d in range(k)], 0, 1)
    errors = {g: sorted(int(abs(p - y) * 100) / 100 for own, y, p in rows if own == g and y is not None and y == y) for g in groups}

    def value(chosen):
        every = sorted(x for g in chosen for x in errors[g])
        return every[math.ceil(len(every) / 2) - 1]

    drawn = [value([groups[numbers[(r, d)] % k] for d in range(k)]) for r in range(reps)]
    got = user_metrics.cluster_bootstrap(df, "y", "p", "g", median_error(), replicates=reps).first()
    want = (value(groups), *np.quantile(drawn, [0.025, 0.975]))
    assert (got["value"], got["value_lo"], got["value_hi"]) == pytest.approx(want)
    each = {r["g"]: r["value"] for r in user_metrics.by_stratum(df, "y", "p", ["g"], median_error()).collect()}
    assert each == {g: value([g]) for g in groups}


def test_user_rmse_equals_the_built_in_one(spark):
    rows = [(k % 9, (k * 37 % 101) / 10, (k * 53 % 97) / 10) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, y double, p double")
    rmse = user_metrics.Additive(lambda y, p: [len(y), ((p - y) ** 2).sum()], lambda s: math.sqrt(s[1] / s[0]))
    mine = user_metrics.cluster_bootstrap(df, "y", "p", "g", rmse, replicates=50).first()
    built = bootstrap.cluster_bootstrap(df, "y", "p", "g", replicates=50).first()
    assert tuple(mine) == pytest.approx((built["rmse"], built["rmse_lo"], built["rmse_hi"]))


# ------------------------------------------------------------------ audits and merges
def test_random_pairs_of_hot_and_thin_cameras(spark):
    rows = [("hot", k // 50, k, (k * 2654435761) % 2**62) for k in range(2000)] + [("thin", 0, 1, 5), ("one_day", 3, 1, 7), ("one_day", 3, 2, 7), ("hot", 1, 9999, None)]
    df = spark.createDataFrame(rows, "cam string, day int, id int, h long")
    few = {r["cam"]: r for r in leakage.random_pair_distances(df, by="cam", day="day", hashes="h", order=["id"], pairs=500, limit=100).collect()}
    whole = {r["cam"]: r for r in leakage.random_pair_distances(df, by="cam", day="day", hashes="h", order=["id"], pairs=500).collect()}
    assert few == whole and set(few) == {"hot"} and 400 < few["hot"]["pairs"] <= 500 and few["hot"]["q05"] <= few["hot"]["q50"] <= few["hot"]["q95"]


def test_hourly_changes_of_a_hot_station(spark):
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=60 * k + rnd.randint(-25, 25)), rnd.uniform(0, 9), rnd.uniform(0, 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "cam string, ts timestamp, v double, h double")
    (plain,) = images.hourly_changes(df, by=["cam"], time="ts", value="v", height="h").collect()
    (split,) = images.hourly_changes(df, by=["cam"], time="ts", value="v", height="h", limit=60).collect()
    gaps = [(b[1] - a[1]).total_seconds() / 3600 for a, b in zip(rows[:-1], rows[1:], strict=True)]
    assert plain["pairs"] == split["pairs"] == sum(0.75 < g < 1.25 for g in gaps) and plain["rho"] == pytest.approx(split["rho"])


def test_merged_fields(spark):
    rows = [(1, 2.0, 1.0, 0.0, [1.0, 3.0]), (1, 8.0, 0.0, 1.0, [3.0, 5.0]), (2, 1.0, 1.0, 0.0, [1.0, 1.0]), (3, 1.0, 1.0, 0.0, [1.0, 1.0]), (3, 1.0, -1.0, 0.0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, hs double, c double, s double, shape array<double>")
    out = {r["id"]: r for r in metrics.merge_seed_fields(df, ["id"], 2, points=["hs"], cos="c", sin="s", shapes={"shape": 2}).collect()}
    assert set(out) == {1, 3} and out[1]["hs"] == pytest.approx(4) and out[1]["direction_deg"] == pytest.approx(45) and out[1]["agreement"] == pytest.approx(math.sqrt(0.5))
    assert out[1]["shape"] == [2.0, 4.0] and out[3]["agreement"] == pytest.approx(0)
    assert [r["id"] for r in metrics.uneven_seeds(df, ["id"], 2).collect()] == [2]


@pytest.mark.parametrize("groups", [500, 1])
def test_rows_of_a_group_are_added_together(spark, groups):
    """Rows of all groups in any order: a call for each group and batch, not for each few rows of a group in a batch."""
    calls = user_metrics.Additive(lambda y, p: [len(y), 1.0], lambda s: s[0])
    df = spark.range(0, 20_000, 1, 8).select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"), F.rand(1).alias("y"), F.rand(2).alias("p"))
    df = df.withColumn("g", F.when(F.col("g") != 3, F.col("g")))  # one group is the missing key
    got = {r["g"]: r["state"] for r in user_metrics.states(df, "y", "p", ["g"], calls).collect()}
    want = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    assert {g: s[0] for g, s in got.items()} == want
    assert sum(s[1] for s in got.values()) < groups + 50
