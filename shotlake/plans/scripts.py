"""Queries of transcripts and timelines over conversations, and of the streaming jobs over events."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.operators import transcript
from shotlake.sources import adapter
from shotlake.sources.adapter import oracle, read
from shotlake.sources.stages import shared_dir
from shotlake.streaming import jobs


def scripts(spark, d):
    """A script per conversation: its turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return read(spark, d, "conversations").groupBy(F.col("conv_id").alias("script_id")).agg(F.array_join(F.transform(turns, lambda t: F.regexp_replace(t["text"], r"\s+", " ")), " ").alias("text"))


def timed(spark, d):
    """The conversations as cues: a turn is as long as its characters / 15 seconds, with a mark in every third."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("script_id"), F.col("turn").cast("int").alias("k"), F.regexp_replace("text", r"\s+", " ").alias("text"), (F.length("text") / 15).alias("_d"))
    w = W.partitionBy("script_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return c.withColumn("end_s", F.sum("_d").over(w)).select("script_id", "k", (F.col("end_s") - F.col("_d")).alias("start_s"), "end_s", F.when(F.col("k") % 3 == 2, F.regexp_replace("text", r"\. ", ". | ")).otherwise(F.col("text")).alias("text"))


def l1_timed_cues(spark, d):
    """SRT files written from the conversations, parsed back."""
    clock = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.floor(c / 3600).cast("int"), F.floor(c / 60).cast("int") % 60, F.floor(c).cast("int") % 60, F.floor(c * 1000).cast("long") % 1000)
    t = timed(spark, d)
    block = F.concat_ws("\n", (F.col("k") + 1).cast("string"), F.concat_ws(" --> ", clock(F.col("start_s")), clock(F.col("end_s"))), F.col("text"))
    files = t.select("script_id", "k", block.alias("b")).groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]), "\n\n").alias("text"))
    return transcript.timed_cues(files).select("script_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.length("text").alias("n"))


def l2_plain_cues(spark, d):
    return transcript.plain_cues(scripts(spark, d)).select("script_id", "k", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"), F.length("text").alias("n"))


def l3_recut(spark, d):
    return transcript.recut(timed(spark, d)).select("script_id", "k", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "text", "hard")


def l6_merge_short(spark, d):
    return transcript.merge_short(transcript.recut(timed(spark, d)))


def l7_divide_long(spark, d):
    return transcript.divide_long(timed(spark, d).withColumn("text", F.trim("text"))).select("script_id", "k", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.length("text").alias("n"))


def l8_beats(spark, d):
    return transcript.beats(timed(spark, d))


def _hits(spark, d):
    """Candidates for beats: each user stands for a beat, events for hits of three ideas."""
    e = read(spark, d, "events")
    rank = F.row_number().over(W.partitionBy("user_id", F.col("event_id") % 3).orderBy(F.desc("value"), "event_id"))
    return e.select(F.col("user_id").alias("beat"), (F.col("event_id") % 3).alias("idea"), rank.alias("rank"), F.get_json_object("props", "$.k").cast("int").alias("shot_id"), "value").withColumn("source_id", F.col("shot_id") % 10)


def h3_candidates(spark, d):
    label = F.element_at(F.array(*map(F.lit, ("weak", "match", "near", "none"))), (F.col("shot_id") % 4 + 1).cast("int"))
    return transcript.candidates(_hits(spark, d).withColumn("label", F.when(label != "none", label)).withColumn("similarity", F.when(F.col("value") > 1, F.round(F.col("value") % 10 / 10, 1))), 2, 8)


def h6_variety(spark, d):
    h = _hits(spark, d).select((F.col("beat") % 10).alias("script_id"), "beat", (F.col("rank") * 3 + F.col("idea")).alias("rank"), "shot_id", F.col("value").alias("score"))
    return transcript.vary(h)


def _placed(spark, d):
    s = adapter.shots(spark, d)
    return s.select("source_id", F.col("shot_index").alias("beat"), "start_s", "end_s", F.when(F.col("status") != "failed", F.col("shot_id")).alias("shot_id"), (F.col("start_s") / 2).alias("in_s"), (F.col("duration_s") * F.col("confidence") * 1.5).alias("length_s"), F.when(F.col("setting") == "Brand#1", 29.97).otherwise(25.0).alias("source_fps"), F.when(F.col("shot_type") == "wide", "image").otherwise("video").alias("kind"), F.lit(25.0).alias("fps")).withColumnRenamed("source_id", "script_id")


def l12_gaps(spark, d):
    p = _placed(spark, d)
    return p.filter("shot_id is null or length_s < end_s - start_s").select("script_id", "beat", F.round(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s") - F.when(F.col("shot_id").isNull(), 0.0).otherwise(F.col("length_s"))), 4).alias("short_by"))


def l14_timeline(spark, d):
    return transcript.timeline(_placed(spark, d))


def l15_timecode(spark, d):
    return adapter.shots(spark, d).select("shot_id", transcript.timecode(transcript.frames(F.col("end_s") * 97, F.lit(25.0)), F.lit(25)).alias("tc"))


def a10_guarded_csv(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("=SUM("), "c_name", F.lit(")"))).when(F.col("c_custkey") % 3 == 1, F.col("c_acctbal").cast("string")).otherwise(F.concat(F.lit("-"), "c_name")).alias("v"))
    return c.select("c_custkey", transcript.guarded(F.col("v")).startswith("'").alias("guarded"))


def _stream(spark, d):
    path = f"{d}/events.parquet"
    raw = spark.readStream.schema(read(spark, d, "events").schema).option("maxFilesPerTrigger", 4).parquet(path + "*")
    return _calls(raw).withWatermark("at", jobs.DELAY)


def _calls(events):
    return events.select(F.col("event_id").alias("call_id"), F.concat(F.lit("lib"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), F.col("value").alias("cost_usd"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id"))


def _folder(spark):
    return shared_dir(spark)


def p2_rolling_spend(spark, d):
    return jobs.run_once(jobs.spend_windows(_stream(spark, d)), "append", _folder(spark))


def p3_runs(spark, d):
    return jobs.run_once(jobs.runs(_stream(spark, d)), "append", _folder(spark))


def p4_cap_crossings(spark, d):
    return jobs.cap_crossings(_calls(read(spark, d, "events")), 1000.0)


def p5_pass_rates(spark, d):
    return jobs.pass_rates(_calls(read(spark, d, "events")))


def p5_pace(spark, d):
    return jobs.pace(jobs.pass_rates(_calls(read(spark, d, "events")), least=1), 0.75, 0.85).groupBy("pace").agg(F.count("*").alias("n"))


def p6_refusals(spark, d):
    return jobs.refusals_in_a_row(_calls(read(spark, d, "events"))).groupBy("keys").agg(F.count("*").alias("n"))


def p7_term_counts(spark, d):
    return jobs.run_once(jobs.term_counts(_stream(spark, d)), "complete", _folder(spark))


def p8_outcomes(spark, d):
    return jobs.run_once(jobs.outcomes(_stream(spark, d)), "append", _folder(spark))


_CALLS = """calls AS (SELECT event_id AS call_id, 'lib' || (user_id % 4) AS workspace_id, ts, event_type AS kind, value AS cost_usd, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, event_type <> 'error' AS ok, 'job' || user_id AS job_id FROM events),
    last AS (SELECT max(ts) - INTERVAL 1 HOUR AS l FROM events)"""
_TIMED = """timed AS (SELECT conv_id AS script_id, CAST(turn AS INT) AS k, regexp_replace(text, '\\s+', ' ', 'g') AS text, sum(d) OVER (PARTITION BY conv_id ORDER BY turn) AS end_s, d FROM (SELECT *, len(text) / 15 AS d FROM conversations))"""

_RAW = f"{_TIMED}, raw AS (SELECT script_id, k, end_s - d AS start_s, end_s, CASE WHEN k % 3 = 2 THEN regexp_replace(text, '\\. ', '. | ', 'g') ELSE text END AS text FROM timed)"
_CUES = f"{_TIMED}, cues AS (SELECT script_id, k, end_s - d AS start_s, end_s, trim(CASE WHEN k % 3 = 2 THEN regexp_replace(text, '\\. ', '. | ', 'g') ELSE text END) AS text FROM timed)"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
_SENTENCES = "string_split(regexp_replace(regexp_replace({}, '([.!?])\\s+([A-Z0-9\"''(])', '\\1' || chr(1) || '\\2', 'g'), '([.!?])\\s+([A-Z0-9\"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"

ORACLE = {
    "l12_gaps": oracle("""SELECT source_id AS script_id, shot_index AS beat, round(greatest(0, duration_s - CASE WHEN status = 'failed' THEN 0 ELSE duration_s * confidence * 1.5 END), 4) AS short_by
        FROM shots WHERE status = 'failed' OR duration_s * confidence * 1.5 < duration_s""", "shots"),
    "l15_timecode": oracle("""SELECT shot_id, format('{:02d}:{:02d}:{:02d}:{:02d}', f // 25 // 3600, f // 25 // 60 % 60, f // 25 % 60, f % 25) AS tc FROM (SELECT shot_id, CAST(round_even(end_s * 97 * 25, 0) AS INT) AS f FROM shots)""", "shots"),
    "a10_guarded_csv": "SELECT c_custkey, c_custkey % 3 <> 1 AS guarded FROM customer",
    "h3_candidates": """WITH h AS (SELECT user_id AS beat, event_id % 3 AS idea, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY value DESC, event_id) AS rank, CAST(json_extract_string(props, '$.k') AS INT) AS shot_id, value FROM events),
        k AS (SELECT *, CASE shot_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS v, -coalesce(nullif(CASE WHEN value > 1 THEN round(value % 10 / 10, 1) END, 0), -1) AS s FROM h),
        o AS (SELECT beat, shot_id, min({'v': v, 's': s, 'r': rank}) AS best FROM k GROUP BY ALL),
        a AS (SELECT *, shot_id % 10 AS source_id FROM h QUALIFY row_number() OVER (PARTITION BY beat, shot_id ORDER BY rank, idea) = 1),
        b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY beat, source_id ORDER BY rank, idea, shot_id) <= 2)
        SELECT beat, row_number() OVER (PARTITION BY beat ORDER BY best, turn) AS place, shot_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY beat ORDER BY rank, idea, shot_id) AS turn FROM b QUALIFY turn <= 8) JOIN o USING (beat, shot_id)""",
    "p2_rolling_spend": f"""WITH {_CALLS} SELECT workspace_id, s AS start, s + INTERVAL 24 HOUR AS stop, round(sum(cost_usd), 4) AS usd, count(*) AS calls FROM (
        SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 6 HOUR AS s FROM calls, range(4) r(i)) GROUP BY ALL HAVING s + INTERVAL 24 HOUR <= (SELECT l FROM last)""",
    "p3_runs": f"""WITH {_CALLS} SELECT workspace_id, min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS stop, round(sum(cost_usd), 4) AS usd, count(*) AS calls FROM (
        SELECT *, sum(n) OVER (PARTITION BY workspace_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY workspace_id ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS n FROM calls))
        GROUP BY workspace_id, g HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT l FROM last)""",
    "p4_cap_crossings": f"""WITH {_CALLS} SELECT workspace_id, day, call_id, round(spent, 4) AS spent FROM (
        SELECT *, CAST(ts AS DATE) AS day, sum(cost_usd) OVER (PARTITION BY workspace_id, CAST(ts AS DATE) ORDER BY ts, call_id) AS spent FROM calls) WHERE round(spent, 6) >= 1000
        QUALIFY row_number() OVER (PARTITION BY workspace_id, day ORDER BY ts, call_id) = 1""",
    "p5_pass_rates": f"""WITH {_CALLS} SELECT s AS start, round(avg(CAST(ok AS DOUBLE)), 6) AS rate, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 10 MINUTE AS s FROM calls, range(3) r(i)) GROUP BY ALL HAVING count(*) >= 5""",
    "p5_pace": f"""WITH {_CALLS}, r AS (SELECT s, avg(CAST(ok AS DOUBLE)) AS rate FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 10 MINUTE AS s FROM calls, range(3) r(i)) GROUP BY ALL)
        SELECT pace, count(*) AS n FROM (SELECT coalesce(last_value(CASE WHEN round(rate, 6) < 0.75 THEN 'slow' WHEN round(rate, 6) > 0.85 THEN 'fast' END IGNORE NULLS) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING), 'fast') AS pace FROM r) GROUP BY ALL""",
    "p6_refusals": f"""WITH {_CALLS} SELECT keys, count(*) AS n FROM (SELECT count(DISTINCT job_id) AS keys FROM (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY workspace_id ORDER BY ts, call_id) AS stretch FROM calls) WHERE NOT ok GROUP BY workspace_id, stretch) GROUP BY ALL""",
    "p7_term_counts": f"WITH {_CALLS} SELECT kind || '_' || (tokens % 10) AS term, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM calls GROUP BY ALL",
    "p8_outcomes": f"""WITH {_CALLS} SELECT s AS start, s + INTERVAL 10 MINUTE AS stop, count_if(ok) AS passed, count_if(NOT ok) AS refused FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS s FROM calls) GROUP BY ALL HAVING s + INTERVAL 10 MINUTE <= (SELECT l FROM last)""",
    "l7_divide_long": f"""WITH {_CUES}, w AS (SELECT *, {_WORDS.format('text')} AS ws, end_s - start_s AS span FROM cues), n AS (SELECT *, len(ws) AS c, CASE WHEN span <= 15 OR len(ws) = 0 THEN 1 ELSE CAST(floor(span / 15) AS INT) + 1 END AS n FROM w),
        p AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE least(c, i * greatest(1, c // n)) END AS a, CASE WHEN n = 1 OR i = n - 1 THEN c ELSE least(c, (i + 1) * greatest(1, c // n)) END AS z FROM n, LATERAL (SELECT unnest(range(n)) AS i))
        SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY k, i) - 1 AS k, round(CASE WHEN n = 1 THEN start_s ELSE start_s + span * a / c END, 3) AS start_s, round(CASE WHEN n = 1 THEN start_s + span ELSE start_s + span * z / c END, 3) AS end_s, CASE WHEN n = 1 THEN len(text) ELSE len(array_to_string(ws[a + 1:z], ' ')) END AS n FROM p WHERE n = 1 OR z > a""",
    "l2_plain_cues": f"""WITH s AS (SELECT conv_id AS script_id, string_agg(regexp_replace(text, '\\s+', ' ', 'g'), ' ' ORDER BY turn) AS text FROM conversations GROUP BY ALL),
        p AS (SELECT script_id, unnest({_SENTENCES.format('trim(text)')}) AS text, unnest(range(len({_SENTENCES.format('trim(text)')}))) AS k FROM s), d AS (SELECT *, greatest(1.0, len({_WORDS.format('text')}) * 60.0 / 150) AS d FROM p WHERE text <> '')
        SELECT script_id, k, round((sum(d) OVER w - d)::DOUBLE, 4) AS start_s, round((sum(d) OVER w)::DOUBLE, 4) AS end_s, len(text) AS n FROM d WINDOW w AS (PARTITION BY script_id ORDER BY k)""",
    "l3_recut": f"""WITH {_RAW}, s0 AS (SELECT *, list_filter(list_transform({_SENTENCES.format('text')}, lambda x: trim(x)), lambda x: x <> '') AS ps FROM raw),
        s1 AS (SELECT script_id, k, start_s, end_s, CASE WHEN len(ps) > 1 THEN ps ELSE [text] END AS ps FROM s0), s2 AS (SELECT *, list_transform(ps, lambda p: len({_WORDS.format('p')})) AS ns FROM s1),
        s3 AS (SELECT script_id, k, unnest(range(len(ps))) AS i, unnest(ps) AS t, start_s + (end_s - start_s) * unnest(list_transform(range(len(ps)), lambda i: coalesce(list_sum(ns[1:i]), 0))) / greatest(1, coalesce(list_sum(ns), 0)) AS a, start_s + (end_s - start_s) * unnest(list_transform(range(len(ps)), lambda i: list_sum(ns[1:i + 1]))) / greatest(1, coalesce(list_sum(ns), 0)) AS z FROM s2),
        m0 AS (SELECT script_id, k, i, a, z, trim(t) AS t, t AS whole, coalesce(lag(trim(t) LIKE '%|') OVER (PARTITION BY script_id ORDER BY k, i), false) AS before FROM s3), m1 AS (SELECT *, list_filter(list_transform(string_split(t, '|'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM m0),
        m2 AS (SELECT script_id, k, i, a, z, before OR t LIKE '|%' AS hard, CASE WHEN len(ps) > 0 THEN ps ELSE [whole] END AS ps FROM m1), m3 AS (SELECT *, list_transform(ps, lambda p: len({_WORDS.format('p')})) AS ns FROM m2),
        m4 AS (SELECT script_id, k, i, hard, a, z, unnest(range(len(ps))) AS j, unnest(ps) AS text, unnest(list_transform(range(len(ps)), lambda i: coalesce(list_sum(ns[1:i]), 0))) AS x, unnest(list_transform(range(len(ps)), lambda i: list_sum(ns[1:i + 1]))) AS y, greatest(1, coalesce(list_sum(ns), 0)) AS n FROM m3)
        SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY k, i, j) - 1 AS k, round(a + (z - a) * x / n, 6) AS start_s, round(a + (z - a) * y / n, 6) AS end_s, text, hard OR j > 0 AS hard FROM m4""",
    "l14_timeline": oracle("""SELECT source_id AS script_id, shot_index AS beat, s AS shot_id, x AS from_frame, x + want AS to_frame, have AS frames, want - have AS gap, CAST(round_even(start_s / 2 * rate, 0) AS INT) AS source_from,
            array_to_string(list_filter([CASE WHEN s IS NULL THEN 'no match' END, CASE WHEN have > 0 AND have < want THEN 'short clip' END, CASE WHEN rate <> 25 THEN 'frame rates differ' END], lambda w: w IS NOT NULL), '; ') AS warnings FROM (
        SELECT *, CASE WHEN s IS NULL THEN 0 WHEN shot_type = 'wide' THEN want ELSE least(want, greatest(1, CAST(round_even(duration_s * confidence * 1.5 * 25, 0) AS INT))) END AS have FROM (
            SELECT *, CASE WHEN status <> 'failed' THEN shot_id END AS s, CAST(round_even(start_s * 25, 0) AS INT) AS x, greatest(1, CAST(round_even(end_s * 25, 0) AS INT) - CAST(round_even(start_s * 25, 0) AS INT)) AS want, CASE WHEN setting = 'Brand#1' THEN 29.97 ELSE 25 END::DOUBLE AS rate FROM shots))""", "shots"),
}
QUERIES = {k: v for k, v in list(globals().items()) if len(k) > 2 and k[0] in "ahlp" and k[1].isdigit()}
