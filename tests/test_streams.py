"""Streams against their batch forms."""

from pyspark.sql import functions as F

from shotlake.plans import scripts, streams
from shotlake.streaming import jobs, states

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)


def test_closed_windows_equal_batch(spark):
    calls = scripts._calls(scripts.read(spark, SF, "events"))
    for stream, batch in ((scripts.p2_rolling_spend, jobs.spend_windows), (scripts.p3_runs, jobs.runs), (scripts.p8_outcomes, jobs.outcomes)):
        same(stream(spark, SF), jobs.closed(batch(calls), calls))


def test_crossings(spark):
    calls = scripts._calls(scripts.read(spark, SF, "events"))
    stream = jobs.run_once(jobs.crossing_stream(scripts._stream(spark, SF), 200.0), "append", scripts._folder(spark))
    same(stream, jobs.cap_crossings(calls, 200.0))


def test_new_files_once(spark):
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:01:00"), ("b", 0, "2024-01-01 00:00:00")], "key string, size long, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [(r["key"], r["at"].minute) for r in jobs.new_files(rows).collect()] == [("a", 0)]


def calls_by_hand(spark, rows):
    return spark.createDataFrame(rows, "workspace_id string, call_id long, at string, cost_usd double, job_id string, ok boolean").withColumn("at", F.col("at").cast("timestamp"))


def as_stream(spark, df, tmp_path, order="call_id"):
    """A file, so a micro-batch, for each few rows in their order."""
    rows = df.orderBy(order).collect()
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "10 minutes")


def test_refusals_by_hand(spark, tmp_path):
    """Twelve different files refused and five minutes of silence; a success clears; a file refused twice is one; then it counts anew."""
    rows, n = [], 0

    def call(minute, second, job, ok):
        nonlocal n
        n += 1
        rows.append(("lib", n, f"2024-01-01 00:{minute:02d}:{second:02d}", 1.0, job, ok))

    call(0, 0, "a", True)
    for k in range(12):
        call(1, k, f"j{k}", False)  # twelve in a minute: too soon
    call(4, 59, "j0", False)  # nothing has got through for 299 s
    call(5, 0, "j1", False)  # 300 s
    for k in range(11):
        call(6, k, f"j{k}", False)
    call(6, 30, "j3", False)
    call(7, 0, "late", False)  # twelve again
    call(8, 0, "x", True)
    for k in range(11):
        call(20, k, f"j{k}", False)
    call(30, 0, "end", True)
    call(59, 0, "end", None)
    calls = calls_by_hand(spark, rows)
    want = [("lib", "00:05:00", 12, "00:00:00"), ("lib", "00:07:00", 12, "00:00:00")]
    told = lambda df: sorted((r["workspace_id"], f"{r['at']:%H:%M:%S}", r["keys"], f"{r['since']:%H:%M:%S}") for r in df.collect())
    assert told(states.refusal_rests(calls)) == want
    assert told(jobs.run_once(states.refusal_stream(as_stream(spark, calls, tmp_path)), "append", scripts._folder(spark))) == want


def test_refusals_equal_batch(spark):
    calls = scripts._calls(scripts.read(spark, SF, "events"))
    same(streams.p6_rests(spark, SF), states.passed(states.refusal_rests(calls, 2, 300), calls, jobs.DELAY))


def test_settled_by_hand(spark, tmp_path):
    looks = [("a", 5, 1, 0), ("a", 9, 1, 1), ("a", 9, 2, 2), ("a", 9, 2, 3), ("a", 9, 2, 4), ("b", 0, 1, 0), ("b", 0, 1, 1), ("c", 3, 1, 0), ("d", None, None, 1), ("d", None, None, 2), ("z", 1, 1, 59)]
    df = spark.createDataFrame(looks, "path string, size long, changed long, minute long").withColumn("at", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.col("minute"), F.lit(0)))
    want = [("a", 9, 2, 3)]
    told = lambda rows: [(r["path"], r["size"], r["changed"], r["at"].minute) for r in rows.collect()]
    assert told(states.settled_files(df)) == want
    stream = as_stream(spark, df, tmp_path, "at").drop("minute")
    assert told(jobs.run_once(states.settled_stream(stream), "append", scripts._folder(spark))) == want


def test_trailing_by_hand(spark, tmp_path):
    rows = [("l", 1, "2024-01-01 00:00:00", 1.0, "j", True), ("l", 2, "2024-01-01 23:59:59", 2.0, "j", True), ("l", 3, "2024-01-02 00:00:00", 4.0, "j", True), ("l", 4, "2024-01-02 00:00:00", 8.0, "j", True), ("l", 5, "2024-01-02 00:00:01", None, "j", True), ("l", 6, "2024-01-05 00:00:00", 1.0, "j", True)]
    stream = as_stream(spark, calls_by_hand(spark, rows), tmp_path)
    got = jobs.run_once(states.trailing_stream(stream), "append", scripts._folder(spark))
    assert sorted((r["call_id"], r["spent"]) for r in got.collect()) == [(1, 1.0), (2, 3.0), (3, 15.0), (4, 15.0), (5, 14.0)]


def test_pace_equals_batch(spark):
    calls = scripts._calls(scripts.read(spark, SF, "events"))
    batch = states.pace_changes(states.rates(calls, "30 minutes", "10 minutes", 1), 0.75, 0.85).withColumn("stop", F.col("start") + F.expr("INTERVAL 30 MINUTES"))
    same(streams.p5_pace_stream(spark, SF), jobs.closed(batch, calls).drop("stop"))
