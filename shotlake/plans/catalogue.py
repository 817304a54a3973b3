"""Queries of catalogue scans, curation, filters, joins and usage over the adapted tables."""

from pyspark.sql import functions as F

from shotlake.operators import catalog, filters, quality, usage
from shotlake.sources import adapter
from shotlake.sources.adapter import oracle, read


def a1_sources_newest(spark, d):
    return catalog.newest(adapter.sources(spark, d), "created_at", "source_id", 50, "indexed").select("source_id", "created_at")


def a2_shots_by_status(spark, d):
    return adapter.shots(spark, d).filter("status = 'indexed'").select("shot_id", "caption")


def a3_lookup_by_hash(spark, d):
    s = adapter.sources(spark, d)
    return catalog.lookup(s, s.filter("status = 'needs_review'"), "content_hash").select("source_id", "content_hash")


def a5_media_kind(spark, d):
    return adapter.sources(spark, d).select(catalog.media_kind(F.col("filename")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def a6_listing_paths(spark, d):
    """Places as a listing: regions hold nations, nations their suppliers."""
    r = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"))
    return catalog.with_paths(r.union(n).union(s)).select("id", "path")


def a9_upsert(spark, d):
    base = read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").filter("c_custkey % 3 <> 0")
    new = read(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return catalog.upsert(base, new, "c_custkey")


def a12_projection(spark, d):
    s = adapter.shots(spark, d)
    clock = F.format_string("%02d:%02d", F.floor(F.col("start_s") / 60).cast("int"), F.floor(F.col("start_s") % 60).cast("int"))
    return s.select("shot_id", clock.alias("at"), F.round("confidence", 1).alias("confidence"), F.array_join("tags", ", ").alias("tags"), F.concat(F.lit("/shot/"), "source_id", F.lit("#t="), F.floor("start_s").cast("int").cast("string")).alias("link"))


def a13_remove_source(spark, d):
    gone = adapter.sources(spark, d).filter("status = 'pending'")
    return catalog.without_source(adapter.shots(spark, d), gone).groupBy("source_id").agg(F.count("*").alias("n"))


def a14_prune(spark, d):
    s = adapter.shots(spark, d)
    return catalog.prunable(s, s.select("source_id", F.lit(4).alias("keep")).distinct(), adapter.usage(spark, d)).select("shot_id")


def a15_clear_counts(spark, d):
    mine = adapter.sources(spark, d).filter("workspace_id = 'lib1'")
    return catalog.counts_of(sources=mine, shots=adapter.shots(spark, d).join(mine, "source_id", "left_semi"))


def b1_normalise(spark, d):
    raw = read(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), F.initcap("p_name"), F.lit("  "), "p_type", F.lit(" ;., ")).alias("v"))
    return raw.select("p_partkey", quality.normalise_term(F.col("v")).alias("term"))


def b2_enum_alias(spark, d):
    return read(spark, d, "orders").select("o_orderkey", quality.coerce_enum(F.col("o_orderpriority"), {"1_urgent": "urgent", "2_high": "high"}).alias("priority"))


def b3_reject_enum(spark, d):
    ok, bad = quality.split_enum(read(spark, d, "part"), "p_type", ("SMALL", "LARGE", "PROMO"))
    return ok.groupBy().agg(F.count("*").alias("accepted")).crossJoin(bad.groupBy().agg(F.count("*").alias("rejected")))


def b4_clean_list(spark, d):
    raw = read(spark, d, "part").select("p_partkey", F.array(F.upper("p_name"), F.lit(" "), F.col("p_name"), "p_type", "p_brand", F.lit(None)).alias("v"))
    return raw.select("p_partkey", F.array_join(quality.clean_list(F.col("v"), 2), "|").alias("tags"))


def b5_clamp(spark, d):
    raw = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit("high")).otherwise((F.col("c_acctbal") / 5000).cast("string")).alias("v"))
    return raw.select("c_custkey", F.round(quality.clamp(F.col("v"), 0.5), 6).alias("confidence"))


def b6_out_of_vocabulary(spark, d):
    vocab = read(spark, d, "part").filter("p_size <= 10").select(F.lit("action").alias("field"), F.lower("p_type").alias("term")).union(read(spark, d, "part").filter("p_size <= 3").select(F.lit("setting"), "p_brand")).distinct()
    return quality.out_of_vocabulary(adapter.shots(spark, d), {"action": "action", "setting": "setting"}, vocab).groupBy("field", "term").agg(F.count("*").alias("n"))


def b7_candidates(spark, d):
    l = adapter.ledger(spark, d).select(F.lit("kind").alias("field"), F.concat_ws("_", "kind", (F.col("tokens") % 10).cast("string")).alias("term"), "at")
    return quality.candidates(l, "at", 5)


def b11_mentioned(spark, d):
    s = adapter.shots(spark, d)
    return s.select("shot_id", quality.mentioned(F.concat_ws(" ", F.col("tags")[0], F.lit("gears")), F.col("caption")).alias("m")).groupBy("m").agg(F.count("*").alias("n"))


def b12_evidence(spark, d):
    s = adapter.shots(spark, d).withColumn("tags", F.concat("tags", F.array("action", F.lit("ghost"), F.lit("hope"), F.lit("calm"), F.lit("hope")))).withColumn("themes", F.concat("mood", F.array(F.lit("nothing"), F.lit("rest"))))
    tags, themes = quality.evidence(F.col("tags"), F.col("themes"), F.col("caption"), ("red",), ("blue",), ("calm", "tense", "green"), ("hope", "rest", "warm", "cool", "loss"))
    return s.select("shot_id", F.array_join(tags, ",").alias("tags"), F.array_join(themes, ",").alias("themes"))


def b13_review_reasons(spark, d):
    s = adapter.shots(spark, d)
    reasons = quality.review_reasons(F.col("confidence"), F.when(F.col("shot_type") != "wide", F.col("duration_s") / 50), F.col("top_pick") & (F.col("shot_type") == "wide"), F.col("quality_flags"), ("shaky", "dark"))
    return s.select("shot_id", F.array_join(reasons, ",").alias("reasons"))


def b15_intake(spark, d):
    s = adapter.sources(spark, d)
    verdict, detail = catalog.intake(F.col("status") == "needs_review", F.when(F.col("width") != 640, F.lit(250_000_000)), 100.0, 200.0, 0.15, 0.05)
    return s.select("source_id", verdict.alias("verdict"), F.regexp_replace(detail, r"^[0-9.]+ GB", "x GB").alias("detail"), catalog.human_duration(F.col("duration_s") * 60).alias("long"))


def b16_failures(spark, d):
    """Errors of a log by the list their file goes to, and whether to try again, to mend the setup, or to wait for the drive."""
    texts = ("429 too many requests", "Connection timed out", "no such file", "no free disk space", "Download stopped early", "moov atom not found", "downloadQuotaExceeded", "https://www.googleapis.com/drive/v3/x: Server returned 403 Forbidden", "invalid_grant", "download is empty")
    log = adapter.ledger(spark, d).select("call_id", F.concat_ws(" ", "kind", F.element_at(F.array(*map(F.lit, texts)), (F.col("tokens") % 10 + 1).cast("int"))).alias("message"))
    return log.groupBy(*(f(F.col("message")).alias(n) for n, f in (("failure", quality.failure_kind), ("again", quality.transient), ("setup", quality.environment), ("drive", quality.drive_quota)))).agg(F.count("*").alias("n"))


def b17_snap_fps(spark, d):
    return read(spark, d, "part").select("p_partkey", quality.snap_fps(F.lit(23.5) + F.col("p_partkey") % 400 / 10).alias("fps"))


def b18_fingerprint(spark, d):
    return read(spark, d, "documents").select("doc_id", quality.fingerprint(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


def b19_duplicates(spark, d):
    return catalog.duplicate_files(adapter.sources(spark, d))


def b20_tags(spark, d):
    t = adapter.shots(spark, d).select("shot_id", F.explode("tags").alias("tag")).select("shot_id", F.lower(F.trim("tag")).alias("tag")).filter("tag <> ''").dropDuplicates()
    return t.groupBy("shot_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))


def b21_search_text(spark, d):
    s = adapter.shots(spark, d)
    return s.select("shot_id", quality.joined("caption", "action", "setting", "tags").alias("picture"), quality.joined("mood").alias("concept"))


def b23_category_terms(spark, d):
    return adapter.sources(spark, d).select("source_id", F.array_join(quality.folder_words(F.concat(F.lit("01_"), "category")), "|").alias("words"))


def b24_canonical_time(spark, d):
    return read(spark, d, "events").select("event_id", F.date_trunc("second", F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))).alias("at"))


def b25_corrections(spark, d):
    s = adapter.shots(spark, d).select("shot_id", "setting", "status")
    fix = s.filter("shot_id like '%-0'").select("shot_id", F.lit(True).alias("has_setting"), F.concat(F.lit("fixed "), "setting").alias("new_setting"))
    return quality.overlay(s, fix, "shot_id", ["setting"])


def b26_source_status(spark, d):
    return catalog.source_status(adapter.sources(spark, d), adapter.shots(spark, d))


def b27_missing_shots(spark, d):
    s = adapter.shots(spark, d)
    plan = s.groupBy("source_id").agg(F.max("shot_index").alias("m")).select("source_id", F.explode(F.sequence(F.lit(0), F.col("m") + 1)).alias("shot_index"))
    return plan.join(s, ["source_id", "shot_index"], "left_anti")


def b28_primary(spark, d):
    return catalog.primary_shots(adapter.shots(spark, d)).select("source_id", "shot_id", "duration_s")


def b29_reanalyse(spark, d):
    s = adapter.shots(spark, d)
    old = F.split("analysis_version", r"\.")[1].cast("int") < 6
    return s.filter(old).join(adapter.sources(spark, d).filter(F.col("category").startswith("ASIA/")), "source_id", "left_semi").agg(F.count("*").alias("n"), F.round(F.count("*") * 0.0039, 4).alias("usd"))


def b32_dry_run(spark, d):
    s = adapter.sources(spark, d)
    return s.groupBy(catalog.intake_verdict(300.0, 250_000_000).alias("verdict"), "media_kind").agg(F.count("*").alias("n"), F.round(F.sum("filesize_bytes") / 1e9, 3).alias("gb"))


def c1_in_lists(spark, d):
    return filters.where(adapter.shots(spark, d), {"in": {"shot_type": ["wide", "close_up"], "action": ["promo"]}}).select("shot_id")


def c2_any_of(spark, d):
    return filters.where(adapter.shots(spark, d), {"any": {"mood": ["calm"], "tags": ["red", "blue"]}}).select("shot_id")


def c3_duration(spark, d):
    s = adapter.shots(spark, d).join(adapter.sources(spark, d).select("source_id", "media_kind"), "source_id")
    return filters.where(s, {"min_duration": 10, "max_duration": 20}).select("shot_id")


def c4_folders(spark, d):
    s = adapter.sources(spark, d).withColumn("secondary", F.array(F.regexp_replace("category", "^[^/]+", "ASIA")))
    return filters.where(s, {"folders": ["ASIA/NATION_2", "EUROPE"]}, id_column="source_id").select("source_id")


def c6_booleans(spark, d):
    return filters.where(adapter.shots(spark, d), {"flags": {"top_pick": True}}).select("shot_id")


def c7_width(spark, d):
    return filters.where(adapter.sources(spark, d), {"min": {"width": 1920}}).select("source_id")


def c8_quality_flags(spark, d):
    s = adapter.shots(spark, d)
    a = filters.where(s, {"all_flags": ["shaky"], "no_flags": ["dark"]}).select("shot_id", F.lit("has").alias("side"))
    return a.union(filters.where(s, {"clean": True}).select("shot_id", F.lit("clean")))


def c9_added(spark, d):
    return filters.where(adapter.sources(spark, d), {"after": "1995-01-01", "before": "1996-01-01"}).select("source_id")


def c10_exclude(spark, d):
    return adapter.shots(spark, d).join(adapter.usage(spark, d), "shot_id", "left_anti").groupBy("status").agg(F.count("*").alias("n"))


def i1_shots_sources(spark, d):
    return adapter.shots(spark, d).join(adapter.sources(spark, d), "source_id").groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("files"))


def i2_match_files(spark, d):
    s = adapter.sources(spark, d).withColumn("size", F.conv(F.substring("content_hash", 1, 4), 16, 10).cast("long"))
    originals = s.filter("width > 640").select(F.col("source_id").alias("orig_id"), F.when(F.col("width") == 1280, F.upper("filename")).otherwise(F.concat(F.lit("old "), "filename")).alias("orig_name"), F.upper("content_hash").alias("md5"), "size")
    return usage.match_files(s.select(F.col("source_id").alias("id"), F.col("filename").alias("name"), F.col("content_hash").alias("md5"), "size"), originals, s.filter("status = 'indexed'").select(F.col("source_id").alias("orig_id")))


def i5_enqueue(spark, d):
    s = adapter.sources(spark, d)
    return s.join(s.filter("status = 'pending'"), "filename", "left_anti").join(s.filter("width = 640"), "filename", "left_anti").dropDuplicates(["filename"]).select("filename")


def i7_usage_history(spark, d):
    return usage.history(adapter.shots(spark, d).filter("shot_index = 0"), adapter.usage(spark, d), 5)


def i8_best_frames(spark, d):
    s = adapter.shots(spark, d).filter("shot_index < 2").select("shot_id", "start_s", "end_s", (F.col("start_s") + 5).alias("lo"), (F.col("start_s") + 9).alias("hi"))
    frames = s.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("shot_id", (F.col("start_s") + F.col("t") * (F.col("end_s") - F.col("start_s")) / 4).alias("t"))
    return usage.frames_in_window(frames, s.select("shot_id", "lo", "hi")).select("shot_id", F.round("t", 4).alias("t"))


def i11_find_library(spark, d):
    libs = read(spark, d, "nation").select(F.concat(F.lit("id"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    asked = read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("id"), F.col("s_nationkey"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("  nation_"), F.col("s_nationkey"))).otherwise(F.concat(F.lit("Nation-"), F.col("s_nationkey"))).alias("q"))
    return usage.find_library(asked, libs, "s_suppkey")


def m1_record_usage(spark, d):
    have = adapter.usage(spark, d)
    want = have.filter("project = 'p1'").select("shot_id").union(have.filter("project = 'p2'").select("shot_id")).distinct()
    return usage.record(have, want, "p1", adapter.shots(spark, d)).groupBy("project", "action").agg(F.count("*").alias("n"))


def m2_used_in_project(spark, d):
    return usage.in_project(adapter.usage(spark, d), "p1", "b1")


def m3_used_elsewhere(spark, d):
    return usage.since(adapter.usage(spark, d), "2024-01-15", "p1")


def m4_usage_listing(spark, d):
    return adapter.usage(spark, d).filter("project = 'p3'").orderBy(F.desc("used_at"), "shot_id").limit(20).select("shot_id", "used_at")


def m5_exclusions(spark, d):
    u = adapter.usage(spark, d)
    out = usage.in_project(u, "p1", "b1").union(usage.since(u, "2024-01-28", "p1")).distinct()
    return adapter.shots(spark, d).filter("shot_index = 0").join(out, "shot_id", "left_anti").groupBy("status").agg(F.count("*").alias("n"))


def h8_latest(spark, d):
    l = adapter.ledger(spark, d)
    return l.groupBy("job_id").agg(F.max_by(F.struct("kind", "tokens"), F.struct("at", "call_id")).alias("x")).select("job_id", "x.kind", "x.tokens")


def n1_fingerprint(spark, d):
    return usage.fingerprints(adapter.shots(spark, d).select("shot_id", "caption", "status"), "shot_id")


def n2_changed(spark, d):
    now = adapter.shots(spark, d).select("shot_id", "caption", "status")
    sent = now.filter("shot_id not like '%-3'").withColumn("status", F.when(F.col("shot_id").like("%-1"), "old").otherwise(F.col("status")))
    return usage.changes(usage.fingerprints(now, "shot_id"), usage.fingerprints(sent, "shot_id"), "shot_id").groupBy("change").agg(F.count("*").alias("n"))


def n3_stale(spark, d):
    now = adapter.shots(spark, d).select("shot_id", "caption", "status").filter("shot_id not like '%-2'")
    sent = adapter.shots(spark, d).select("shot_id", "caption", "status")
    return usage.prune(usage.fingerprints(now, "shot_id"), usage.fingerprints(sent, "shot_id"), "shot_id")


def o2_difference(spark, d):
    return adapter.usage(spark, d).select("shot_id").subtract(adapter.shots(spark, d).filter("status = 'indexed'").select("shot_id"))


def o3_intersection(spark, d):
    return adapter.usage(spark, d).select("shot_id").intersect(adapter.shots(spark, d).filter("status = 'indexed'").select("shot_id"))


_STEMS = "list_transform(regexp_extract_all(lower({}), '[a-z0-9'']+'), lambda w: w[1:5])"
_IDEA = "t IN ('calm', 'tense', 'green', 'hope', 'rest', 'warm', 'cool', 'loss') AND NOT (len({T}) > 0 AND list_has_all({STEMS}, {T}))"
_HUMAN = "(CASE WHEN round_even({0}, 0) >= 3600 THEN format('{{:d}} h {{:02d}} min', round_even({0}, 0)::BIGINT // 3600, round_even({0}, 0)::BIGINT % 3600 // 60) WHEN round_even({0}, 0) >= 60 THEN format('{{:d}} min {{:02d}} s', round_even({0}, 0)::BIGINT // 60, round_even({0}, 0)::BIGINT % 60) ELSE round_even({0}, 0)::BIGINT || ' s' END)"
ORACLE = {
    "a1_sources_newest": oracle("SELECT source_id, created_at FROM sources WHERE status = 'indexed' ORDER BY created_at DESC, source_id LIMIT 50", "sources"),
    "a2_shots_by_status": oracle("SELECT shot_id, caption FROM shots WHERE status = 'indexed'", "shots"),
    "a3_lookup_by_hash": oracle("SELECT source_id, content_hash FROM sources WHERE content_hash IN (SELECT content_hash FROM sources WHERE status = 'needs_review')", "sources"),
    "a5_media_kind": oracle("SELECT media_kind AS kind, count(*) AS n FROM sources GROUP BY ALL", "sources"),
    "a6_listing_paths": """SELECT 'r' || r_regionkey AS id, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 's' || s_suppkey, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "a9_upsert": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal,
        CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""",
    "a12_projection": oracle("""SELECT shot_id, format('{:02d}:{:02d}', CAST(floor(start_s / 60) AS INT), CAST(floor(start_s % 60) AS INT)) AS "at", round(confidence, 1) AS confidence, array_to_string(tags, ', ') AS tags,
        '/shot/' || source_id || '#t=' || CAST(floor(start_s) AS INT) AS link FROM shots""", "shots"),
    "a13_remove_source": oracle("SELECT source_id, count(*) AS n FROM shots WHERE source_id NOT IN (SELECT source_id FROM sources WHERE status = 'pending') GROUP BY ALL", "sources", "shots"),
    "a14_prune": oracle("SELECT shot_id FROM shots WHERE shot_index >= 4 AND NOT top_pick AND shot_id NOT IN (SELECT shot_id FROM usage)", "shots", "usage"),
    "a15_clear_counts": oracle("""SELECT 'sources' AS "table", count(*) AS n FROM sources WHERE workspace_id = 'lib1' UNION ALL SELECT 'shots', count(*) FROM shots WHERE source_id IN (SELECT source_id FROM sources WHERE workspace_id = 'lib1')""", "sources", "shots"),
    "b1_normalise": "SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS term FROM part",
    "b2_enum_alias": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') END AS priority FROM orders",
    "b3_reject_enum": "SELECT count(*) FILTER (p_type IN ('SMALL', 'LARGE', 'PROMO')) AS accepted, count(*) FILTER (p_type NOT IN ('SMALL', 'LARGE', 'PROMO')) AS rejected FROM part",
    "b4_clean_list": "SELECT p_partkey, lower(p_name) || '|' || lower(p_type) AS tags FROM part",
    "b5_clamp": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.5 ELSE round(least(1, greatest(0, c_acctbal / 5000)), 6) END AS confidence FROM customer",
    "b6_out_of_vocabulary": oracle("""SELECT field, term, count(*) AS n FROM (SELECT 'action' AS field, action AS term FROM shots UNION ALL SELECT 'setting', setting FROM shots)
        WHERE (field, term) NOT IN (SELECT 'action', lower(p_type) FROM part WHERE p_size <= 10 UNION SELECT 'setting', p_brand FROM part WHERE p_size <= 3) GROUP BY ALL""", "shots"),
    "b7_candidates": oracle("""SELECT 'kind' AS field, kind || '_' || (tokens % 10) AS term, count(*) AS n, min("at") AS first_seen, max("at") AS last_seen FROM ledger GROUP BY ALL HAVING count(*) >= 5""", "ledger"),
    "b11_mentioned": oracle(f"SELECT list_has_all({_STEMS.format('caption')}, {_STEMS.format("tags[1] || ' gears'")}) AS m, count(*) AS n FROM shots GROUP BY ALL", "shots"),
    "b12_evidence": oracle(f"""SELECT shot_id, array_to_string(list_filter(ws, lambda t: NOT ({_IDEA.format(STEMS=_STEMS.format("caption"), T=_STEMS.format("t"))})), ',') AS tags,
        array_to_string(list_concat(given, list_filter(ws, lambda t: t IN ('hope', 'rest', 'warm', 'cool', 'loss') AND NOT list_contains(given, t) AND {_IDEA.format(STEMS=_STEMS.format("caption"), T=_STEMS.format("t"))}))[1:4], ',') AS themes FROM (
        SELECT shot_id, caption, list_filter(all_, lambda t, i: list_position(all_, t) = i AND t NOT IN ('red', 'blue')) AS ws, list_filter(list_concat(mood, ['rest']), lambda t: t IN ('hope', 'rest', 'warm', 'cool', 'loss')) AS given
        FROM (SELECT *, list_concat(tags, [action, 'ghost', 'hope', 'calm', 'hope']) AS all_ FROM shots))""", "shots"),
    "b13_review_reasons": oracle("""SELECT shot_id, array_to_string(list_filter([CASE WHEN confidence < 0.7 THEN 'low_confidence' END, CASE WHEN shot_type <> 'wide' AND duration_s / 50 < 0.6 THEN 'low_category_confidence' END,
        CASE WHEN top_pick AND shot_type = 'wide' THEN 'category_unmatched' END, CASE WHEN list_has_any(quality_flags, ['shaky', 'dark']) THEN 'quality_defect' END], lambda x: x IS NOT NULL), ',') AS reasons FROM shots""", "shots"),
    "b15_intake": oracle(f"""SELECT source_id, CASE WHEN too_long THEN 'too_long' WHEN fulls OR big THEN 'too_big' END AS verdict,
        CASE WHEN too_long THEN {_HUMAN.format("duration_s")} || ' long; the limit is ' || CASE WHEN forced THEN '3 min 20 s' ELSE '1 min 40 s' END || '. Probably a recording rather than B-roll.'
             WHEN fulls THEN 'x GB is more than this server can hold at once (0.2 GB free to use).' WHEN big THEN 'x GB; the limit is 0.15 GB.' END AS detail, {_HUMAN.format("duration_s * 60")} AS long
        FROM (SELECT *, coalesce(media_kind <> 'image', true) AND duration_s > CASE WHEN forced THEN 200 ELSE 100 END AS too_long, forced AND width <> 640 AND filesize_bytes > 200000000 AS fulls, NOT forced AND filesize_bytes > 150000000 AS big FROM (SELECT *, status = 'needs_review' AS forced FROM sources))""", "sources"),
    "b16_failures": oracle("""SELECT CASE tokens % 10 WHEN 3 THEN 'too_big' WHEN 4 THEN 'download_incomplete' WHEN 9 THEN 'download_incomplete' WHEN 5 THEN 'unreadable' ELSE 'analysis_failed' END AS failure, tokens % 10 IN (0, 1, 6, 7, 8) AS again, tokens % 10 IN (6, 7, 8) AS setup, tokens % 10 IN (6, 7) AS drive, count(*) AS n FROM ledger GROUP BY ALL""", "ledger"),
    "b17_snap_fps": """SELECT p_partkey, coalesce((SELECT r FROM (VALUES (23.976), (24.0), (25.0), (29.97), (30.0), (48.0), (50.0), (59.94), (60.0)) v(r) WHERE abs(f - r) / r <= 0.015 ORDER BY abs(f - r), r LIMIT 1)::DOUBLE, round(f, 3)) AS fps
        FROM (SELECT p_partkey, 23.5 + p_partkey % 400 / 10 AS f FROM part)""",
    "b18_fingerprint": """SELECT doc_id, sha256(CAST(octet_length(b) AS VARCHAR)::BLOB || b[1:1048576] || CASE WHEN octet_length(b) > 2097152 THEN b[octet_length(b) - 1048575:octet_length(b)] ELSE ''::BLOB END) AS hash FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)""",
    "b19_duplicates": oracle("""SELECT source_id, kept_id, workspace_id, content_hash FROM (SELECT *, row_number() OVER w AS r, first_value(source_id) OVER w AS kept_id FROM sources
        WINDOW w AS (PARTITION BY workspace_id, content_hash ORDER BY created_at, source_id)) WHERE r > 1""", "sources"),
    "b20_tags": oracle("SELECT shot_id, array_to_string(list_sort(list_distinct(tags)), ',') AS tags FROM shots", "shots"),
    "b21_search_text": oracle("SELECT shot_id, caption || ', ' || action || ', ' || setting || ', ' || array_to_string(tags, ', ') AS picture, array_to_string(mood, ', ') AS concept FROM shots", "shots"),
    "b23_category_terms": oracle("SELECT source_id, array_to_string(list_reverse(string_split(category, '/')), '|') AS words FROM sources", "sources"),
    "b24_canonical_time": "SELECT event_id, date_trunc('second', ts) AS \"at\" FROM events",
    "b25_corrections": oracle("SELECT shot_id, CASE WHEN shot_index = 0 THEN 'fixed ' || setting ELSE setting END AS setting, CASE WHEN shot_index = 0 THEN 'indexed' ELSE status END AS status, shot_index = 0 AS corrected FROM shots", "shots"),
    "b26_source_status": oracle("""SELECT source_id, CASE WHEN n IS NULL THEN 'pending' WHEN review > 0 THEN 'needs_review' WHEN failed = n THEN 'failed' ELSE 'indexed' END AS status, version FROM sources LEFT JOIN (
        SELECT source_id, count(*) AS n, count_if(status = 'needs_review') AS review, count_if(status = 'failed') AS failed, arg_min(analysis_version, CAST(split_part(analysis_version, '.', 2) AS INT)) AS version FROM shots GROUP BY ALL) USING (source_id)""", "sources", "shots"),
    "b27_missing_shots": oracle("SELECT source_id, max(shot_index) + 1 AS shot_index FROM shots GROUP BY ALL", "shots"),
    "b28_primary": oracle("SELECT source_id, shot_id, duration_s FROM shots QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY duration_s DESC, shot_index) = 1", "shots"),
    "b29_reanalyse": oracle("SELECT count(*) AS n, round((count(*) * 0.0039)::DOUBLE, 4) AS usd FROM shots JOIN sources USING (source_id) WHERE CAST(split_part(analysis_version, '.', 2) AS INT) < 6 AND category LIKE 'ASIA/%'", "sources", "shots"),
    "b32_dry_run": oracle("SELECT CASE WHEN media_kind <> 'image' AND duration_s > 300 THEN 'too_long' WHEN filesize_bytes > 250000000 THEN 'too_big' ELSE 'ok' END AS verdict, media_kind, count(*) AS n, round(sum(filesize_bytes) / 1e9, 3) AS gb FROM sources GROUP BY ALL", "sources"),
    "c1_in_lists": oracle("SELECT shot_id FROM shots WHERE shot_type IN ('wide', 'close_up') AND action = 'promo' AND status IN ('indexed', 'needs_review')", "shots"),
    "c2_any_of": oracle("SELECT shot_id FROM shots WHERE list_contains(mood, 'calm') AND list_has_any(tags, ['red', 'blue']) AND status IN ('indexed', 'needs_review')", "shots"),
    "c3_duration": oracle("SELECT shot_id FROM shots s JOIN sources USING (source_id) WHERE (s.duration_s BETWEEN 10 AND 20 OR media_kind = 'image') AND s.status IN ('indexed', 'needs_review')", "sources", "shots"),
    "c4_folders": oracle("""SELECT source_id FROM (SELECT *, regexp_replace(category, '^[^/]+', 'ASIA') AS sec FROM sources) WHERE status IN ('indexed', 'needs_review') AND
        (category = 'ASIA/NATION_2' OR starts_with(category, 'ASIA/NATION_2/') OR starts_with(category, 'EUROPE/') OR sec = 'ASIA/NATION_2' OR starts_with(sec, 'ASIA/NATION_2/'))""", "sources"),
    "c6_booleans": oracle("SELECT shot_id FROM shots WHERE top_pick AND status IN ('indexed', 'needs_review')", "shots"),
    "c7_width": oracle("SELECT source_id FROM sources WHERE width >= 1920 AND status IN ('indexed', 'needs_review')", "sources"),
    "c8_quality_flags": oracle("""SELECT shot_id, 'has' AS side FROM shots WHERE list_contains(quality_flags, 'shaky') AND NOT list_contains(quality_flags, 'dark') AND status IN ('indexed', 'needs_review')
        UNION ALL SELECT shot_id, 'clean' FROM shots WHERE len(quality_flags) = 0 AND status IN ('indexed', 'needs_review')""", "shots"),
    "c9_added": oracle("SELECT source_id FROM sources WHERE created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND status IN ('indexed', 'needs_review')", "sources"),
    "c10_exclude": oracle("SELECT status, count(*) AS n FROM shots WHERE shot_id NOT IN (SELECT shot_id FROM usage) GROUP BY ALL", "shots", "usage"),
    "i1_shots_sources": oracle("SELECT category, count(*) AS n, count(DISTINCT source_id) AS files FROM shots JOIN sources USING (source_id) GROUP BY ALL", "sources", "shots"),
    "i2_match_files": oracle("""SELECT id, orig_id, renamed, identical, CASE WHEN orig_id IS NULL THEN 'unmatched' WHEN row_number() OVER (PARTITION BY orig_id ORDER BY id) > 1 THEN 'duplicate' WHEN orig_id IN (SELECT source_id FROM sources WHERE status = 'indexed') THEN 'already_indexed' ELSE 'matched' END AS status FROM (
        SELECT l.source_id AS id, o.source_id AS orig_id, l.filename <> o.name AS renamed, CASE WHEN o.source_id IS NOT NULL THEN count(*) OVER (PARTITION BY l.source_id) END AS identical
        FROM (SELECT *, ('0x' || content_hash[1:4])::BIGINT AS size FROM sources) l LEFT JOIN (SELECT source_id, content_hash, ('0x' || content_hash[1:4])::BIGINT AS size, CASE WHEN width = 1280 THEN upper(filename) ELSE 'old ' || filename END AS name FROM sources WHERE width > 640) o ON o.content_hash = l.content_hash AND o.size = l.size AND l.size > 0
        QUALIFY row_number() OVER (PARTITION BY l.source_id ORDER BY lower(l.filename) <> lower(o.name), o.source_id) = 1)""", "sources"),
    "i5_enqueue": oracle("SELECT DISTINCT filename FROM sources WHERE filename NOT IN (SELECT filename FROM sources WHERE status = 'pending' OR width = 640)", "sources"),
    "i7_usage_history": oracle("""SELECT s.shot_id, count(u.project) AS uses, coalesce(string_agg(project, ',' ORDER BY used_at DESC, project) FILTER (r <= 5), '') AS recent FROM shots s
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY used_at DESC, project) AS r FROM usage) u USING (shot_id) WHERE shot_index = 0 GROUP BY ALL""", "shots", "usage"),
    "i8_best_frames": oracle("""SELECT shot_id, round(t, 4) AS t FROM (SELECT *, max(t BETWEEN lo AND hi) OVER (PARTITION BY shot_id) AS hit_any FROM (
        SELECT shot_id, start_s + i * (end_s - start_s) / 4 AS t, start_s + 5 AS lo, start_s + 9 AS hi FROM shots, range(4) r(i) WHERE shot_index < 2)) WHERE t BETWEEN lo AND hi OR NOT hit_any""", "shots"),
    "i11_find_library": "SELECT s_suppkey, 'id' || s_nationkey AS id FROM supplier",
    "m1_record_usage": oracle("""SELECT 'p1' AS project, CASE WHEN w.shot_id IS NULL THEN 'released' WHEN s.shot_id IS NULL THEN 'unknown' WHEN h.shot_id IS NULL THEN 'added' ELSE 'kept' END AS action, count(*) AS n
        FROM (SELECT shot_id FROM usage WHERE project = 'p1') h FULL JOIN (SELECT DISTINCT shot_id FROM usage WHERE project IN ('p1', 'p2')) w USING (shot_id) LEFT JOIN shots s USING (shot_id) GROUP BY ALL""", "shots", "usage"),
    "m2_used_in_project": oracle("SELECT DISTINCT shot_id FROM usage WHERE project = 'p1' AND (beat IS NULL OR beat <> 'b1')", "usage"),
    "m3_used_elsewhere": oracle("SELECT DISTINCT shot_id FROM usage WHERE project <> 'p1' AND used_at >= TIMESTAMP '2024-01-15'", "usage"),
    "m4_usage_listing": oracle("SELECT shot_id, used_at FROM usage WHERE project = 'p3' ORDER BY used_at DESC, shot_id LIMIT 20", "usage"),
    "m5_exclusions": oracle("""SELECT status, count(*) AS n FROM shots WHERE shot_index = 0 AND shot_id NOT IN (SELECT shot_id FROM usage WHERE (project = 'p1' AND (beat IS NULL OR beat <> 'b1')) OR (project <> 'p1' AND used_at >= TIMESTAMP '2024-01-28')) GROUP BY ALL""", "shots", "usage"),
    "h8_latest": oracle("""SELECT job_id, kind, tokens FROM ledger QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY "at" DESC, call_id DESC) = 1""", "ledger"),
    "n1_fingerprint": oracle("SELECT shot_id, sha1('{\"caption\":\"' || caption || '\",\"status\":\"' || status || '\"}') AS fingerprint FROM shots", "shots"),
    "n2_changed": oracle("SELECT CASE WHEN shot_index = 3 OR shot_id LIKE '%-3' THEN 'new' ELSE 'changed' END AS change, count(*) AS n FROM shots WHERE shot_id LIKE '%-3' OR shot_id LIKE '%-1' GROUP BY ALL", "shots"),
    "n3_stale": oracle("SELECT count_if(shot_id LIKE '%-2') AS stale, count(*) AS sent, count(*) - count_if(shot_id LIKE '%-2') AS current, count_if(shot_id LIKE '%-2') > greatest(20, 0.3 * count(*)) AS refused FROM shots", "shots"),
    "o2_difference": oracle("SELECT shot_id FROM usage EXCEPT SELECT shot_id FROM shots WHERE status = 'indexed'", "shots", "usage"),
    "o3_intersection": oracle("SELECT shot_id FROM usage INTERSECT SELECT shot_id FROM shots WHERE status = 'indexed'", "shots", "usage"),
}
QUERIES = {k: v for k, v in list(globals().items()) if len(k) > 2 and k[0] in "abchimno" and k[1].isdigit()}
