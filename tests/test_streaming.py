from pyspark.sql import functions as F

from tidewright.operators import qc
from tidewright.session import table
from tidewright.streaming import jobs


def parts(events, folder, n):
    """The events as n files in time order."""
    for i in range(n):
        events.where(F.floor(F.dayofmonth("ts") * n / 32) == i).coalesce(1).write.parquet(f"{folder}/f{i}")


def source(spark, events, folder):
    s = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    return s.parquet(folder)


def load(spark, small):
    return table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def test_change_log_over_batches(spark, small, tmp_path):
    events = load(spark, small)
    parts(events, f"{tmp_path}/in", 3)
    log = jobs.ChangeLog(f"{tmp_path}/log", ["user_id"], ["ts", "event_id"])
    jobs.run_batches(source(spark, events, f"{tmp_path}/in"), log.write, f"{tmp_path}/state")
    want = {r[0]: r[1] for r in events.groupBy("user_id").agg(F.max_by("event_id", "ts")).collect()}
    assert {r["user_id"]: r["event_id"] for r in log.read(spark).collect()} == want
    log.write(events.limit(5), 0)  # a replayed batch replaces itself
    small_log = log.compact(spark, f"{tmp_path}/log2")
    assert {r["user_id"]: r["event_id"] for r in small_log.read(spark).collect()} == {
        r["user_id"]: r["event_id"] for r in log.read(spark).collect()
    }


def test_trailing_quality_is_the_batch_result(spark, small, tmp_path):
    events = load(spark, small)
    parts(events, f"{tmp_path}/in", 4)
    each = jobs.trailing_quality(f"{tmp_path}/h", ["user_id"], "ts", "value", "3d", 1.5)
    jobs.run_batches(source(spark, events, f"{tmp_path}/in"), each, f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/h/flags").select("event_id", "mean_std_flag")
    want = qc.mean_std(events, by=["user_id"], time="ts", value="value", window="3d", n_std=1.5)
    late = events.agg(F.max("ts")).first()[0]
    assert late and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("event_id", "mean_std_flag").collect()))


def test_replayed_batch_gives_the_same_flags(spark, small, tmp_path):
    events = load(spark, small)
    each = jobs.trailing_quality(f"{tmp_path}/h", ["user_id"], "ts", "value", "3d", 1.5)
    first, second = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    flags = lambda k: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/h/flags/batch={k}").select("event_id", "mean_std_flag").collect()))
    each(first, 0)
    each(second, 1)
    before = flags(0), flags(1)
    each(first, 0)
    each(second, 1)
    assert (flags(0), flags(1)) == before


def test_ledger_lines_that_do_not_fit_are_kept(spark, tmp_path):
    from tidewright.sources.ledgers import LEDGER

    fields = spark.createDataFrame([], LEDGER).schema.fields
    names = [f.name for f in fields]
    good = ",".join("2024-01-01T00:00:00Z" if f.dataType.typeName() == "timestamp" else "1" for f in fields)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.csv").write_text("\n".join([",".join(names), good, "cut,row"]) + "\n")
    seen = []
    each = jobs.split_rejects(lambda rows, k: seen.append(rows.count()), f"{tmp_path}/rejects")
    jobs.run_batches(jobs.open_ledger(spark, f"{tmp_path}/in"), each, f"{tmp_path}/state")
    assert seen == [1] and [r[0] for r in spark.read.parquet(f"{tmp_path}/rejects").select("rejected").collect()] == ["cut,row"]


def test_hourly_counts_and_late_rows(spark, tmp_path):
    def rows(*times):
        return spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts"), F.lit("a").alias("k"))

    rows("2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 05:00:00").coalesce(1).write.parquet(f"{tmp_path}/in/f0")
    out = f"{tmp_path}/out"
    spec = spark.readStream.schema("ts timestamp, k string").option("recursiveFileLookup", True)

    def run():
        s = jobs.hourly_counts(spec.parquet(f"{tmp_path}/in"), "ts", ["k"], "2 hours")
        return jobs.run_to_parquet(s, out, f"{tmp_path}/state")

    run()
    rows("2024-01-01 00:20:00", "2024-01-01 09:00:00").coalesce(1).write.parquet(f"{tmp_path}/in/f1")
    q = run()
    got = {str(r["hour"])[11:13]: r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {"00": 2, "05": 1}
    assert jobs.dropped_late_rows(q) == 1


def test_left_outer_join_keeps_targets(spark, tmp_path):
    def put(name, *rows):
        df = spark.createDataFrame(list(rows), "id int, t string").select("id", F.to_timestamp("t").alias(f"{name}_t"), F.lit(1).alias("k"))
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return df.schema

    a = put("a", (1, "2024-01-01 00:00:00"), (2, "2024-01-01 03:00:00"), (9, "2024-01-02 00:00:00"))
    b = put("b", (5, "2024-01-01 00:20:00"), (6, "2024-01-02 00:00:00"))
    s = jobs.interval_join(
        spark.readStream.schema(a).parquet(f"{tmp_path}/a"),
        spark.readStream.schema(b).parquet(f"{tmp_path}/b").withColumnRenamed("id", "ref"),
        ["k"], "a_t", "b_t", delay="1 hour", how="leftOuter",
    ).select("id", "ref")
    jobs.run_to_parquet(s, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r["id"], r["ref"]) for r in spark.read.schema("id int, ref int").parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 5), (2, None), (9, 6)}
