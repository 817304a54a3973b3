"""Queries of streams that keep state in order of time, over the events as they arrive."""

from pyspark.sql import functions as F

from shotlake.plans import scripts
from shotlake.sources.adapter import read
from shotlake.sources.stages import shared_dir
from shotlake.streaming import jobs, states


def _run(spark, stream):
    return jobs.run_once(stream, "append", shared_dir(spark))


def _listings(events):
    """Sweeps over files: an event shows its user's file with a size and time that often repeat."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.concat(F.lit("/inbox/"), F.col("user_id").cast("string")).alias("path"), (k % 3).alias("size"), F.when(F.col("event_type") == "view", 1).otherwise(2).cast("long").alias("changed"), F.col("ts").cast("timestamp").alias("at"))


def p1_settled(spark, d):
    """Files that two sweeps found the same, from a stream of sweeps."""
    raw = spark.readStream.schema(read(spark, d, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")
    return _run(spark, states.settled_stream(_listings(raw).withWatermark("at", jobs.DELAY)))


def p2_trailing_stream(spark, d):
    """What each call sees as spent in the last 24 hours, as calls arrive."""
    return _run(spark, states.trailing_stream(scripts._stream(spark, d))).select("call_id", "spent")


def p5_pace_stream(spark, d):
    """Changes of pace of each library, from rates over half an hour."""
    with states.rocksdb(spark):
        return _run(spark, states.pace_stream(states.rates(scripts._stream(spark, d), "30 minutes", "10 minutes", 1), 0.75, 0.85))


def p5_rests(spark, d):
    """Windows in which under a fifth of a library's calls went through."""
    return states.rests(scripts._calls(read(spark, d, "events")), 0.2, least=1).select("workspace_id", "start", "rate", "n")


def p6_rests(spark, d):
    """When refusals in a row make a library rest, as calls arrive."""
    return _run(spark, states.refusal_stream(scripts._stream(spark, d), 2, 300))


_CALLS = scripts._CALLS.rstrip().rstrip(",")
_LAST = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {jobs.DELAY} FROM events)"
_RATES = """rates AS (SELECT workspace_id, s, round(avg(CAST(coalesce(ok, false) AS DOUBLE)), 6) AS rate, count(*) AS n FROM (
    SELECT *, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 10 MINUTE AS s FROM calls, range(3) r(i)) GROUP BY ALL)"""
ORACLE = {
    "p1_settled": f"""SELECT path, size, changed, ts AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, size, changed) AS r FROM (
        SELECT *, size > 0 AND size = lag(size) OVER w AND changed = lag(changed) OVER w AS same FROM (
            SELECT '/inbox/' || user_id AS path, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS size, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS changed, ts FROM events)
        WINDOW w AS (PARTITION BY path ORDER BY ts, size, changed)) WHERE same) WHERE r = 1 AND ts < {_LAST}""",
    "p2_trailing_stream": f"""SELECT call_id, spent FROM (SELECT event_id AS call_id, ts, round(sum(value) OVER (PARTITION BY user_id % 4 ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS spent FROM events) WHERE ts < {_LAST}""",
    "p5_rests": f"WITH {_CALLS}, {_RATES} SELECT workspace_id, s AS start, rate, n FROM rates WHERE rate < 0.2",
    "p5_pace_stream": f"""WITH {_CALLS}, {_RATES}, turns AS (SELECT workspace_id, s, CASE WHEN rate < 0.75 THEN 'slow' WHEN rate > 0.85 THEN 'fast' END AS pace FROM rates WHERE rate < 0.75 OR rate > 0.85)
        SELECT workspace_id, s AS start, pace FROM (SELECT *, lag(pace, 1, 'fast') OVER (PARTITION BY workspace_id ORDER BY s) AS was FROM turns) WHERE pace <> was AND s + INTERVAL 30 MINUTE <= {_LAST}""",
}
QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "p" and k[1:2].isdigit()}
