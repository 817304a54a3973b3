"""Queries of facets, the ledger, placement and segments over the adapted tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.operators import catalog, facets, hybrid, placement, quality, segments
from shotlake.sources import adapter
from shotlake.sources.adapter import oracle, read

FACETS = ["action", "setting", "shot_type", "camera_movement"]


def g1_counts(spark, d):
    return adapter.shots(spark, d).withColumnRenamed("status", "shot_status").join(adapter.sources(spark, d).select("source_id", "media_kind"), "source_id").groupBy("shot_status", "media_kind").agg(F.count("*").alias("n"))


def g2_by_status(spark, d):
    return adapter.sources(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def g3_facet_counts(spark, d):
    s = adapter.shots(spark, d).join(adapter.sources(spark, d).select("source_id", F.coalesce("media_kind", F.lit("none")).alias("media_kind")), "source_id")
    return facets.facet_counts(s, FACETS, ["mood", "tags"], "media_kind")


def g4_facet_pairs(spark, d):
    return facets.pair_counts(adapter.shots(spark, d), "tags", "mood")


def g5_folder_rollup(spark, d):
    rows = adapter.sources(spark, d).filter("status <> 'pending'")
    every = adapter.sources(spark, d).select(F.explode(facets.ancestors(F.col("category"))).alias("folder")).distinct()
    return facets.folder_rollup(rows, every, "source_id", "category", "created_at", 4)


def g6_ancestors(spark, d):
    return adapter.sources(spark, d).select(F.explode(facets.ancestors(F.col("category"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def g8_offered(spark, d):
    vocab = read(spark, d, "part").filter("p_size < 5").select(F.col("p_brand").alias("value")).distinct()
    return facets.facet_counts(adapter.shots(spark, d), ["setting"], []).join(vocab, "value").select("value", "n")


def g9_tag_audit(spark, d):
    s = adapter.shots(spark, d)
    return facets.tag_audit(s.select("shot_id", F.explode("tags").alias("tag")), s.count())


def g9_audit_report(spark, d):
    """The audit as rows: the commonest tags, and figures over all shots."""
    return facets.audit_report(adapter.shots(spark, d), 25)


def g10_histogram(spark, d):
    return facets.histogram(adapter.shots(spark, d), "confidence", [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.01])


def g12_reason_counts(spark, d):
    return adapter.shots(spark, d).select(F.explode(F.array_distinct("quality_flags")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def g13_ledger_totals(spark, d):
    return facets.ledger_totals(adapter.ledger(spark, d))


def g14_trailing_spend(spark, d):
    return facets.trailing_spend(adapter.ledger(spark, d), "workspace_id").select("call_id", "spent")


def g15_spend_report(spark, d):
    l = adapter.ledger(spark, d)
    return l.groupBy("workspace_id").agg(F.round(F.sum("cost_usd"), 2).alias("usd"), F.count_distinct("job_id").alias("jobs")).withColumn("per_job", F.round(F.col("usd") / F.col("jobs"), 4)).withColumn("for_1000", F.round(F.col("usd") / F.col("jobs") * 1000, 2)).withColumn("over_cap", F.col("usd") > 60_000)


def g16_price(spark, d):
    l = adapter.ledger(spark, d).withColumn("cached", F.col("tokens") % 20)
    return l.select("call_id", F.round(facets.price(F.col("kind"), F.col("tokens"), F.col("cached"), {"view": (300.0, 0.001), "click": (2500.0, 0.0)}), 8).alias("usd"))


def _jobs(spark, d):
    """A job per call: what happened stands for its state, and an error text for its last error."""
    state = F.create_map(*(F.lit(x) for x in ("click", "running", "view", "done", "error", "failed", "purchase", "queued", "signup", "cancelled")))
    texts = ("429 Too many requests per day", "Daily limit reached: 429", "connection reset", "no such file", "")
    ext = F.element_at(F.array(*map(F.lit, (".mp4", ".jpg", ".txt"))), (F.col("tokens") % 3 + 1).cast("int"))
    return adapter.ledger(spark, d).select("workspace_id", F.col("call_id").alias("job_id"), state[F.col("kind")].alias("status"), F.col("at").alias("created_at"), F.concat(F.lit("take"), ext).alias("filename"), F.element_at(F.array(*map(F.lit, texts)), (F.col("tokens") % 5 + 1).cast("int")).alias("last_error"))


def g17_job_panel(spark, d):
    return facets.recent_jobs(_jobs(spark, d), 40).select("workspace_id", "place", "job_id", "status")


def g17_by_side(spark, d):
    return facets.jobs_by_side(_jobs(spark, d), F.coalesce(catalog.media_kind(F.col("filename")), F.lit("video")))


def g18_waits(spark, d):
    return facets.waits(_jobs(spark, d), quality.transient(F.col("last_error")))


def g19_overview(spark, d):
    s = adapter.sources(spark, d)
    shots = adapter.shots(spark, d).join(s.select("source_id", "workspace_id"), "source_id").groupBy("workspace_id").agg(F.count("*").alias("shots"), F.count_if(F.col("status") == "needs_review").alias("review"))
    return s.groupBy("workspace_id").agg(F.count("*").alias("clips"), F.count_if(F.col("status") == "pending").alias("queued")).join(shots, "workspace_id", "full_outer")


def g20_proposals(spark, d):
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("parent"), F.concat(F.lit("Place"), F.col("c_nationkey") % 5, F.when(F.col("c_custkey") % 3 == 0, "s").otherwise("")).alias("name"), F.col("c_custkey").alias("source_id"))
    tree = read(spark, d, "customer").select(F.col("c_mktsegment").alias("parent"), F.lit("place-2").alias("name")).distinct()
    return facets.merge_proposals(c, 50, tree)


def g21_refile_matrix(spark, d):
    r = _refile(spark, d)
    return r.groupBy("before", "after", "action").agg(F.count("*").alias("n"))


def g22_job_totals(spark, d):
    return adapter.ledger(spark, d).groupBy("job_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 4).alias("usd"))


def h1_number(spark, d):
    s = adapter.shots(spark, d).filter("status <> 'failed'")
    return s.select("shot_id", (F.row_number().over(W.partitionBy("source_id").orderBy("start_s")) - 1).alias("k"))


def h2_cap(spark, d):
    s = adapter.shots(spark, d).filter("status <> 'failed'")
    r = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("duration_s"), "start_s"))
    return s.select("shot_id", F.when(r > 2, "skipped").otherwise("usable").alias("mark"))


def h7_fps_vote(spark, d):
    s = adapter.shots(spark, d).withColumn("fps", F.element_at(F.array(F.lit(24.0), F.lit(25.0), F.lit(30.0)), (F.pmod(F.length("setting"), F.lit(3)) + 1).cast("int")))
    per = s.groupBy("source_id", "fps").agg(F.count("*").alias("n"), F.min("shot_index").alias("first"))
    w = W.partitionBy("source_id")
    return per.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "first"))).withColumn("mixed", F.count("*").over(w) > 1).filter("r = 1").select("source_id", "fps", "mixed")


def f7_across_libraries(spark, d):
    l = adapter.ledger(spark, d).select(F.col("workspace_id").alias("query_id"), F.col("call_id").alias("doc"), F.col("cost_usd").alias("score"))
    return hybrid.ranked(l, 5).orderBy(F.desc("score"), "doc").limit(12).select("query_id", "doc", "score")


def f8_tabs(spark, d):
    s = adapter.sources(spark, d).filter("media_kind is not null")
    w = W.partitionBy("workspace_id", "media_kind")
    return s.withColumn("r", F.row_number().over(w.orderBy(F.desc("duration_s"), "source_id"))).withColumn("n", F.count("*").over(w)).filter("r <= 6").select("workspace_id", "media_kind", "r", "source_id", "n", (F.col("n") > 6).alias("more"))


def j1_labels(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("v")).distinct().select("v", placement.label(F.col("v")).alias("label"), placement.slug(F.col("v")).alias("slug"))


def j2_file_names(spark, d):
    s = catalog.primary_shots(adapter.shots(spark, d)).join(adapter.sources(spark, d).select("source_id", "content_hash"), "source_id")
    return s.select("source_id", placement.file_name([F.col("action"), F.col("setting"), F.array_join("tags", " ")], F.col("content_hash"), F.lit(".mp4"), 20).alias("name"))


def j3_timecodes(spark, d):
    s = adapter.shots(spark, d)
    return s.select("shot_id", placement.with_timecode(F.concat("source_id", F.lit(".mp4")), F.col("start_s"), F.col("shot_index") == 0).alias("name"))


def j4_top_values(spark, d):
    return placement.top_values(facets.facet_counts(adapter.shots(spark, d), FACETS, ["tags"]), 8)


def j5_third_level(spark, d):
    return placement.third_level(facets.pair_counts(adapter.shots(spark, d), "tags", "mood"), 5)


def _desired(spark, d):
    s = adapter.sources(spark, d)
    return placement.distinct_names(s.select(F.col("category").alias("folder"), F.concat(F.date_format("created_at", "yyyy-MM"), F.lit(".mp4")).alias("name"), "source_id"))


def j10_desired(spark, d):
    return _desired(spark, d)


def j11_folders(spark, d):
    return placement.folders_to_create(adapter.sources(spark, d).select(F.col("category").alias("path")))


def j12_reconcile(spark, d):
    want = _desired(spark, d)
    have = want.filter("source_id not like '%7'").withColumn("source_id", F.when(F.col("source_id").like("%3"), F.concat("source_id", F.lit("x"))).otherwise(F.col("source_id"))).union(want.filter("source_id like '%5'").select(F.concat(F.lit("OLD/"), "folder"), "name", "source_id"))
    return placement.reconcile(want, have).groupBy("action").agg(F.count("*").alias("n"))


def j13_month(spark, d):
    return adapter.sources(spark, d).groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def j14_rename(spark, d):
    return adapter.sources(spark, d).select("source_id", placement.renamed(F.col("category"), "ASIA/NATION_2", "EAST/TWO").alias("category"))


def j15_remove(spark, d):
    s = adapter.sources(spark, d).select("source_id", "category", F.array(F.regexp_replace("category", "^[^/]+", "ASIA"), F.lit("EUROPE")).alias("secondary"))
    return placement.removed(s, "ASIA", None).select("source_id", "category", "flagged", F.array_join("secondary", ",").alias("secondary"))


def _refile(spark, d):
    s = adapter.sources(spark, d)
    k = F.col("source_id").cast("long")
    rows = s.select("source_id", F.col("workspace_id").alias("before"), F.when(k % 5 > 0, F.concat(F.lit("lib"), k % 6)).alias("after"), (k % 10 / 10).alias("confidence"))
    return placement.refile(rows.withColumn("known", F.coalesce(F.col("after") != "lib5", F.lit(False))))


def j16_refile(spark, d):
    return _refile(spark, d).groupBy("action").agg(F.count("*").alias("n"))


def j17_attention(spark, d):
    s = adapter.sources(spark, d)
    stored = s.filter("width < 1920").select(F.col("source_id").alias("key"), F.when(F.col("status") == "pending", "dismissed").when(F.col("status") == "indexed", "resolved").otherwise("open").alias("status"), F.col("filesize_bytes").alias("size_bytes"))
    flags = s.filter("cast(source_id as long) % 2 = 0").select(F.col("source_id").alias("key"), F.lit(None).cast("long").alias("size_bytes"))
    return placement.merge_attention(stored, flags).groupBy("status").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def j9_tree(spark, d):
    c = adapter.sources(spark, d).select(F.explode(facets.ancestors(F.col("category"))).alias("path")).distinct()
    return placement.flatten_tree(c.withColumn("note", F.when(~F.col("path").contains("/"), F.concat(F.lit("all of "), "path")).when(F.col("path").like("%NATION_1%"), "one")))


def _spans(spark, d):
    return adapter.shots(spark, d).select(F.col("source_id").alias("id"), (F.col("start_s") / 10).alias("x"), (F.col("end_s") / 10).alias("y"), F.col("shot_type").alias("kind"))


def k1_windows(spark, d):
    return segments.look_windows(adapter.sources(spark, d).select(F.col("source_id").alias("id"), F.lit(0.0).alias("start"), F.floor("duration_s").cast("double").alias("stop"))).select("id", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def k2_tile(spark, d):
    s = adapter.shots(spark, d).select(F.col("source_id").alias("id"), (F.col("start_s") + F.col("shot_index") % 3 - 1).alias("start"), (F.col("end_s") + F.col("shot_index") % 2).alias("stop"), F.lit(0.0).alias("from"), F.max("end_s").over(W.partitionBy("source_id")).alias("upto"))
    return segments.tile(s)


def k3_absorb(spark, d):
    return segments.absorb_short(_spans(spark, d))


def k5_best_window(spark, d):
    lo, hi = segments.best_window()
    return _spans(spark, d).withColumn("lo", F.col("x") + 0.5).withColumn("hi", F.col("x") + 2.5).select("id", "x", F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))


def k6_merge_cuts(spark, d):
    s = _spans(spark, d).select("id", (F.col("x") + 0.05).alias("x"), (F.col("y") + 0.05).alias("y"), (F.max("y").over(W.partitionBy("id")) + 1).alias("length"))
    return segments.merge_cuts(s).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def k7_frames(spark, d):
    return segments.frame_times(adapter.shots(spark, d).select(F.col("shot_id").alias("id"), F.col("start_s").alias("x"), F.col("end_s").alias("y")))


def k7_weighted(spark, d):
    """Moments weighted to a best part that the confidence places; some shots have none, or a short one."""
    s = adapter.shots(spark, d)
    lo = F.col("start_s") + F.col("duration_s") * F.col("confidence") * 0.5
    s = s.select(F.col("shot_id").alias("id"), F.col("start_s").alias("x"), F.col("end_s").alias("y"), segments.frame_count(F.col("duration_s")).alias("count"), F.when(F.col("shot_index") != 2, lo).alias("lo"), (lo + F.col("duration_s") * 0.25).alias("hi"))
    return segments.weighted_times(s)


def k8_best_frames(spark, d):
    l = read(spark, d, "lineitem")
    f = l.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("attempt")).agg((F.max("l_quantity") * 6).alias("mean"), F.round(F.max(F.abs("l_tax")) * 300 + F.max(F.col("l_partkey") % 7), 4).alias("sd"))
    return segments.best_frames(f)


def k9_trim(spark, d):
    s = adapter.shots(spark, d).withColumn("length_s", F.when(F.col("shot_type") != "wide", F.max("end_s").over(W.partitionBy("source_id")))).withColumn("best_from", F.when(F.col("top_pick"), F.col("start_s") + 1)).withColumn("best_to", F.col("end_s") - 1)
    lo, hi, whole = segments.trim(2.0, 30.0, ("best_from", "best_to"))
    return s.select("shot_id", lo.alias("x"), hi.alias("y"), whole.alias("whole"))


def k10_packing_list(spark, d):
    l = adapter.ledger(spark, d).select(F.col("job_id").alias("list"), F.col("call_id").alias("pos"), (F.col("tokens") % 12).alias("shot_id"), (F.col("tokens") + 1).alias("need"), F.lit(10).alias("rate"))
    return segments.packing_list(l, 4000)


ORACLE = {
    "g1_counts": oracle("SELECT s.status AS shot_status, media_kind, count(*) AS n FROM shots s JOIN sources USING (source_id) GROUP BY ALL", "sources", "shots"),
    "g2_by_status": oracle("SELECT status, count(*) AS n FROM sources GROUP BY ALL", "sources"),
    "g3_facet_counts": oracle("""SELECT facet, value, media_kind, count(*) AS n FROM (SELECT media_kind, x.f AS facet, x.v AS value FROM (
        SELECT coalesce(media_kind, 'none') AS media_kind, unnest([{'f': 'action', 'v': action}, {'f': 'setting', 'v': setting}, {'f': 'shot_type', 'v': shot_type}, {'f': 'camera_movement', 'v': camera_movement}]
            || list_transform(mood, lambda m: {'f': 'mood', 'v': m}) || list_transform(tags, lambda t: {'f': 'tags', 'v': t})) AS x FROM shots JOIN sources USING (source_id)))
        GROUP BY GROUPING SETS ((facet, value, media_kind), (facet, value))""", "sources", "shots"),
    "g4_facet_pairs": oracle("SELECT a, b, count(*) AS n FROM (SELECT a, unnest(mood) AS b FROM (SELECT unnest(tags) AS a, mood FROM shots)) GROUP BY ALL", "shots"),
    "g5_folder_rollup": oracle("""SELECT folder, count(source_id) AS n, coalesce(string_agg(source_id, ',' ORDER BY r) FILTER (r <= 4), '') AS newest, len(string_split(folder, '/')) < 3 AS has_children FROM (
        SELECT f.folder, s.source_id, row_number() OVER (PARTITION BY f.folder ORDER BY s.created_at DESC, s.source_id) AS r FROM (
            SELECT DISTINCT array_to_string(string_split(category, '/')[1:i], '/') AS folder FROM sources, range(1, 4) t(i)) f
        LEFT JOIN (SELECT * FROM sources WHERE status <> 'pending') s ON s.category = f.folder OR starts_with(s.category, f.folder || '/')) GROUP BY ALL""", "sources"),
    "g6_ancestors": oracle("SELECT array_to_string(string_split(category, '/')[1:i], '/') AS folder, count(*) AS n FROM sources, range(1, 4) t(i) GROUP BY ALL", "sources"),
    "g8_offered": oracle("SELECT setting AS value, count(*) AS n FROM shots WHERE setting IN (SELECT p_brand FROM part WHERE p_size < 5) GROUP BY ALL", "shots"),
    "g9_tag_audit": oracle("""SELECT tag, n, round(n / t, 6) AS share, t >= 25 AND n / t > 0.12 AND tag NOT IN ('man', 'men', 'woman', 'women', 'person', 'people', 'group', 'child', 'children', 'boy', 'girl', 'baby', 'crowd') AS too_common, n = 1 AS single FROM (
        SELECT tag, count(*) AS n, (SELECT count(*) FROM shots) AS t FROM (SELECT DISTINCT shot_id, unnest(tags) AS tag FROM shots) GROUP BY ALL)""", "shots"),
    "g9_audit_report": oracle("""SELECT 'most' AS part, tag AS value, n::DOUBLE AS n FROM (SELECT tag, count(DISTINCT shot_id) AS n FROM (SELECT shot_id, unnest(tags) AS tag FROM shots) GROUP BY tag ORDER BY n DESC, tag LIMIT 25)
        UNION ALL SELECT 'shots', '', count(*) FROM shots UNION ALL SELECT 'tags_per_shot', '', round(sum(len(tags)) / count(*), 1) FROM shots UNION ALL SELECT 'needs_review', '', count_if(status = 'needs_review') FROM shots
        UNION ALL SELECT 'distinct_tags', '', count(*) FROM (SELECT DISTINCT unnest(tags) FROM shots) UNION ALL SELECT 'tags_used_once', '', count(*) FROM (SELECT tag FROM (SELECT DISTINCT shot_id, unnest(tags) AS tag FROM shots) GROUP BY tag HAVING count(*) = 1)""", "shots"),
    "g10_histogram": oracle("""SELECT b AS bucket, count(shot_id) AS n FROM (VALUES ('0-0.1', 0, 0.1), ('0.1-0.25', 0.1, 0.25), ('0.25-0.5', 0.25, 0.5), ('0.5-0.75', 0.5, 0.75), ('0.75-0.9', 0.75, 0.9), ('0.9-1.01', 0.9, 1.01)) v(b, lo, hi)
        LEFT JOIN shots ON confidence >= lo::DOUBLE AND confidence < hi::DOUBLE GROUP BY ALL""", "shots"),
    "g12_reason_counts": oracle("SELECT reason, count(*) AS n FROM (SELECT unnest(quality_flags) AS reason FROM shots) GROUP BY ALL", "shots"),
    "g13_ledger_totals": oracle("""SELECT kind, CAST("at" AS DATE) AS day, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost_usd), 2) AS usd, count_if(NOT ok) AS failed FROM ledger GROUP BY ROLLUP (kind, CAST("at" AS DATE))""", "ledger"),
    "g14_trailing_spend": oracle("""SELECT call_id, round(sum(cost_usd) OVER (PARTITION BY workspace_id ORDER BY "at" RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS spent FROM ledger""", "ledger"),
    "g15_spend_report": oracle("""SELECT workspace_id, usd, jobs, round(usd / jobs, 4) AS per_job, round(usd / jobs * 1000, 2) AS for_1000, usd > 60000 AS over_cap FROM (
        SELECT workspace_id, round(sum(cost_usd), 2) AS usd, count(DISTINCT job_id) AS jobs FROM ledger GROUP BY ALL)""", "ledger"),
    "g16_price": oracle("""SELECT call_id, round(CASE kind WHEN 'view' THEN (greatest(tokens - tokens % 20, 0) + least(tokens % 20, tokens) * 0.1::DOUBLE) * 300::DOUBLE / 1e6 + 0.001
        WHEN 'click' THEN (greatest(tokens - tokens % 20, 0) + least(tokens % 20, tokens) * 0.1::DOUBLE) * 2500::DOUBLE / 1e6 ELSE 0 END, 8) AS usd FROM ledger""", "ledger"),
    "g17_job_panel": oracle("""SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY CASE kind WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, "at" DESC, call_id) AS place, call_id AS job_id,
        CASE kind WHEN 'click' THEN 'running' WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status FROM ledger WHERE kind <> 'signup' QUALIFY place <= 40""", "ledger"),
    "g17_by_side": oracle("""SELECT workspace_id, CASE tokens % 3 WHEN 1 THEN 'image' ELSE 'video' END AS side, count_if(kind = 'purchase') AS queued, count_if(kind = 'click') AS running, count_if(kind = 'view') AS done, count_if(kind = 'error') AS failed FROM ledger WHERE kind <> 'signup' GROUP BY ALL""", "ledger"),
    "g18_waits": oracle("SELECT workspace_id, count_if(kind = 'purchase' AND tokens % 5 <= 2) AS waiting, coalesce(bool_or(kind = 'purchase' AND tokens % 5 <= 1), false) AS daily FROM ledger GROUP BY ALL", "ledger"),
    "g19_overview": oracle("""SELECT workspace_id, clips, queued, shots, review FROM (SELECT workspace_id, count(*) AS clips, count_if(status = 'pending') AS queued FROM sources GROUP BY ALL)
        FULL JOIN (SELECT workspace_id, count(*) AS shots, count_if(s.status = 'needs_review') AS review FROM shots s JOIN sources USING (source_id) GROUP BY ALL) USING (workspace_id)""", "sources", "shots"),
    "g20_proposals": """SELECT parent, CASE WHEN p = 2 THEN 'place-2' ELSE arg_min(name, {'a': -n, 'b': name}) END AS name, sum(n)::BIGINT AS files, sum(n) >= 50 AS enough, p = 2 AS existing FROM (
        SELECT c_mktsegment AS parent, c_nationkey % 5 AS p, 'Place' || (c_nationkey % 5) || CASE WHEN c_custkey % 3 = 0 THEN 's' ELSE '' END AS name, count(DISTINCT c_custkey) AS n FROM customer GROUP BY ALL) GROUP BY parent, p""",
    "g22_job_totals": oracle("SELECT job_id, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost_usd), 4) AS usd FROM ledger GROUP BY ALL", "ledger"),
    "h1_number": oracle("SELECT shot_id, row_number() OVER (PARTITION BY source_id ORDER BY start_s) - 1 AS k FROM shots WHERE status <> 'failed'", "shots"),
    "h2_cap": oracle("SELECT shot_id, CASE WHEN row_number() OVER (PARTITION BY source_id ORDER BY duration_s DESC, start_s) > 2 THEN 'skipped' ELSE 'usable' END AS mark FROM shots WHERE status <> 'failed'", "shots"),
    "h7_fps_vote": oracle("""SELECT source_id, fps, k > 1 AS mixed FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, first) AS r, count(*) OVER (PARTITION BY source_id) AS k FROM (
        SELECT source_id, [24.0, 25.0, 30.0][len(setting) % 3 + 1]::DOUBLE AS fps, count(*) AS n, min(shot_index) AS first FROM shots GROUP BY ALL)) WHERE r = 1""", "shots"),
    "f7_across_libraries": oracle("""SELECT workspace_id AS query_id, call_id AS doc, cost_usd AS score FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY cost_usd DESC, call_id) AS r FROM ledger) WHERE r <= 5 ORDER BY score DESC, doc LIMIT 12""", "ledger"),
    "f8_tabs": oracle("""SELECT workspace_id, media_kind, r, source_id, n, n > 6 AS more FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, media_kind ORDER BY duration_s DESC, source_id) AS r, count(*) OVER (PARTITION BY workspace_id, media_kind) AS n
        FROM sources WHERE media_kind IS NOT NULL) WHERE r <= 6""", "sources"),
    "j1_labels": """SELECT DISTINCT o_orderpriority AS v, regexp_replace(o_orderpriority, '[_-]+', ' ', 'g') AS label, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM orders""",
    "j2_file_names": oracle("""SELECT source_id, rtrim(substr(array_to_string(list_transform([action, setting, array_to_string(tags, ' ')], lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', '_', 'g'), '_')), '_'), 1, 20), '_') || '_' || content_hash[1:8] || '.mp4' AS name
        FROM (SELECT * FROM shots QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY duration_s DESC, shot_index) = 1) JOIN sources USING (source_id)""", "sources", "shots"),
    "j3_timecodes": oracle("SELECT shot_id, source_id || CASE WHEN shot_index = 0 THEN '' ELSE format('_{:02d}m{:02d}s', CAST(floor(start_s / 60) AS INT), CAST(floor(start_s % 60) AS INT)) END || '.mp4' AS name FROM shots", "shots"),
    "j4_top_values": oracle("""SELECT facet, value, n, CASE WHEN k <= 8 OR r <= 8 THEN value ELSE 'Other' END AS folder FROM (
        SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY facet) AS k FROM (
        SELECT x.f AS facet, x.v AS value, count(*) AS n FROM (SELECT unnest([{'f': 'action', 'v': action}, {'f': 'setting', 'v': setting}, {'f': 'shot_type', 'v': shot_type}, {'f': 'camera_movement', 'v': camera_movement}]
            || list_transform(tags, lambda t: {'f': 'tags', 'v': t})) AS x FROM shots) GROUP BY ALL))""", "shots"),
    "j5_third_level": oracle("""SELECT a, b, n FROM (SELECT a, b, count(*) AS n FROM (SELECT a, unnest(mood) AS b FROM (SELECT unnest(tags) AS a, mood FROM shots)) GROUP BY ALL HAVING count(*) >= 5)
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1""", "shots"),
    "j10_desired": oracle("""SELECT folder, CASE WHEN k = 1 THEN m || '.mp4' ELSE m || '_dup' || k || '.mp4' END AS name, source_id FROM (
        SELECT category AS folder, strftime(created_at, '%Y-%m') AS m, source_id, row_number() OVER (PARTITION BY category, strftime(created_at, '%Y-%m') ORDER BY source_id) AS k FROM sources)""", "sources"),
    "j11_folders": oracle("SELECT DISTINCT array_to_string(string_split(category, '/')[1:i], '/') AS path, CAST(i AS INT) AS depth FROM sources, range(1, 4) t(i)", "sources"),
    "j12_reconcile": oracle("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN source_id LIKE '%7' THEN 'create' WHEN source_id LIKE '%3' THEN 'conflict' ELSE 'keep' END AS action FROM sources
        UNION ALL SELECT 'delete' FROM sources WHERE source_id LIKE '%5') GROUP BY ALL""", "sources"),
    "j13_month": oracle("SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM sources GROUP BY ALL", "sources"),
    "j14_rename": oracle("SELECT source_id, CASE WHEN category = 'ASIA/NATION_2' OR starts_with(category, 'ASIA/NATION_2/') THEN 'EAST/TWO' || substr(category, 14) ELSE category END AS category FROM sources", "sources"),
    "j15_remove": oracle("SELECT source_id, CASE WHEN starts_with(category, 'ASIA/') THEN NULL ELSE category END AS category, starts_with(category, 'ASIA/') AS flagged, 'EUROPE' AS secondary FROM sources", "sources"),
    "j16_refile": oracle("""SELECT CASE WHEN k % 5 = 0 OR k % 6 = 5 THEN 'unmatched' WHEN 'lib' || (k % 6) = workspace_id THEN 'unchanged' WHEN k % 10 / 10 < 0.6 THEN 'tie' ELSE 'move' END AS action, count(*) AS n
        FROM (SELECT *, CAST(source_id AS BIGINT) AS k FROM sources) GROUP BY ALL""", "sources"),
    "j17_attention": oracle("""SELECT CASE WHEN NOT stored THEN 'open' WHEN status = 'pending' THEN 'dismissed' WHEN flag THEN 'open' WHEN status = 'indexed' THEN 'resolved' ELSE 'open' END AS status, count(*) AS n, sum(CASE WHEN stored THEN filesize_bytes END)::BIGINT AS bytes
        FROM (SELECT *, width < 1920 AS stored, CAST(source_id AS BIGINT) % 2 = 0 AS flag FROM sources) WHERE stored OR flag GROUP BY ALL""", "sources"),
    "g21_refile_matrix": oracle("""SELECT workspace_id AS before, CASE WHEN k % 5 > 0 THEN 'lib' || (k % 6) END AS after, CASE WHEN k % 5 = 0 OR k % 6 = 5 THEN 'unmatched' WHEN 'lib' || (k % 6) = workspace_id THEN 'unchanged' WHEN k % 10 / 10 < 0.6 THEN 'tie' ELSE 'move' END AS action, count(*) AS n
        FROM (SELECT *, CAST(source_id AS BIGINT) AS k FROM sources) GROUP BY ALL""", "sources"),
    "j9_tree": oracle("""SELECT path, CAST(len(string_split(path, '/')) AS INT) AS depth, len(string_split(path, '/')) = 3 AS leaf, array_to_string(list_filter(['all of ' || string_split(path, '/')[1], CASE WHEN len(string_split(path, '/')) > 1 AND contains(array_to_string(string_split(path, '/')[1:2], '/'), 'NATION_1') THEN 'one' END,
        CASE WHEN len(string_split(path, '/')) = 3 AND contains(path, 'NATION_1') THEN 'one' END], lambda x: x IS NOT NULL), '; ') AS notes FROM (SELECT DISTINCT array_to_string(string_split(category, '/')[1:i], '/') AS path FROM sources, range(1, 4) t(i))""", "sources"),
    "k1_windows": oracle("""SELECT id, k, round(k * step, 6) AS x, round(CASE WHEN k = n - 1 THEN stop ELSE (k + 1) * step END, 6) AS y FROM (SELECT *, CASE WHEN n0 > 1 AND stop - (n0 - 1) * step < 10 THEN n0 - 1 ELSE n0 END AS n FROM (
        SELECT *, CAST(greatest(1, ceil(round(stop / step, 9))) AS INT) AS n0 FROM (SELECT source_id AS id, floor(duration_s) AS stop, greatest(60.0::DOUBLE, floor(duration_s) / 20) AS step FROM sources) WHERE stop > 0)), LATERAL (SELECT unnest(range(n)) AS k)""", "sources"),
    "k6_merge_cuts": oracle("""SELECT id, round(x, 4) AS x, round(y, 4) AS y FROM (
        SELECT id, CASE WHEN mean < 2 OR i = lo THEN 0 ELSE x END AS x, CASE WHEN mean < 2 THEN length WHEN i = hi THEN greatest(y, length) ELSE y END AS y, mean < 2 AS one, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM (
            SELECT *, avg(y - x) OVER p AS mean, min(i) OVER p AS lo, max(i) OVER p AS hi FROM (
                SELECT id, i, min(x) AS x, max(y) AS y, any_value(length) AS length FROM (
                    SELECT id, CASE WHEN i = 1 AND max(y) - min(x) < 1.5 THEN 2 ELSE i END AS i, min(x) AS x, max(y) AS y, any_value(length) AS length FROM (
                        SELECT *, sum(CASE WHEN n = 1 OR y - x >= 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY x) AS i FROM (
                            SELECT source_id AS id, start_s / 10 + 0.05::DOUBLE AS x, end_s / 10 + 0.05::DOUBLE AS y, max(end_s / 10) OVER (PARTITION BY source_id) + 1 AS length, row_number() OVER (PARTITION BY source_id ORDER BY start_s) AS n FROM shots)) q GROUP BY q.id, q.i) GROUP BY id, i)
            WINDOW p AS (PARTITION BY id))) WHERE NOT one OR r = 1""", "shots"),
    "k8_best_frames": """WITH f AS (SELECT l_orderkey AS id, l_linenumber AS position, l_partkey AS attempt, max(l_quantity) * 6 AS mean, round((max(abs(l_tax)) * 300 + max(l_partkey % 7))::DOUBLE, 4) AS sd FROM lineitem GROUP BY ALL),
        p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id, position ORDER BY NOT (mean BETWEEN 18 AND 240 AND sd >= 8), CASE WHEN mean BETWEEN 18 AND 240 AND sd >= 8 THEN attempt ELSE -sd END, attempt) = 1)
        SELECT id, arg_max(position, {'s': sd, 'p': -position}) AS position, max(sd) AS sd FROM p GROUP BY id""",
    "k2_tile": oracle("""SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT id, y, coalesce(lag(y) OVER w2, f) AS x FROM (
        SELECT *, least(max(mid) OVER (w ROWS UNBOUNDED PRECEDING), u) AS y FROM (SELECT *, coalesce((e + lead(s) OVER w) / 2, u) AS mid FROM (
            SELECT source_id AS id, greatest(start_s + shot_index % 3 - 1, 0) AS s, least(end_s + shot_index % 2, max(end_s) OVER (PARTITION BY source_id)) AS e, 0.0::DOUBLE AS f, max(end_s) OVER (PARTITION BY source_id) AS u FROM shots)
            WHERE e > s WINDOW w AS (PARTITION BY id ORDER BY s, e)) WINDOW w AS (PARTITION BY id ORDER BY s, e)) WINDOW w2 AS (PARTITION BY id ORDER BY s, e)) WHERE y > x""", "shots"),
    "k5_best_window": oracle("SELECT source_id AS id, x, CASE WHEN least(x + 2.5, y) - (x + 0.5) >= 1 THEN round(x + 0.5, 4) END AS lo, CASE WHEN least(x + 2.5, y) - (x + 0.5) >= 1 THEN round(least(x + 2.5, y), 4) END AS hi FROM (SELECT *, start_s / 10 AS x, end_s / 10 AS y FROM shots)", "shots"),
    "k7_frames": oracle("""SELECT shot_id AS id, CAST(k AS INT) AS k, round(start_s + duration_s * (k + 0.5) / n, 6) AS t FROM (
        SELECT *, greatest(3, least(8, CAST(round_even(duration_s / 4, 0) AS INT))) AS n FROM shots), LATERAL (SELECT unnest(range(n)) AS k)""", "shots"),
    "k7_weighted": oracle("""SELECT id, CAST(i - 1 AS INT) AS k, round(ts[i], 6) AS t FROM (SELECT id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (
        SELECT id, list_sort(CASE WHEN known THEN list_concat(list_transform(range(ins), lambda i: lo + (hi - lo) * (i + 0.5) / ins),
            CASE WHEN lo > x AND bef > 0 THEN list_transform(range(bef), lambda i: x + (lo - x) * (i + 0.5) / bef) ELSE [] END, CASE WHEN y > hi AND cnt - ins - bef > 0 THEN list_transform(range(cnt - ins - bef), lambda i: hi + (y - hi) * (i + 0.5) / (cnt - ins - bef)) ELSE [] END)
            ELSE list_transform(range(cnt), lambda i: x + (y - x) * (i + 0.5) / cnt) END) AS ts FROM (
        SELECT *, least(greatest(CASE WHEN lo - x + y - hi > 0 THEN CAST(round_even((cnt - ins) * (lo - x) / (lo - x + y - hi), 0) AS INT) ELSE 0 END, CASE WHEN lo - x > 0.5 THEN 1 ELSE 0 END), cnt - ins) AS bef, coalesce(raw IS NOT NULL AND cnt >= 4 AND hi - lo >= 1 AND hi - lo < 0.8::DOUBLE * (y - x), false) AS known FROM (
        SELECT *, greatest(x, raw) AS lo, least(y, best + duration_s * 0.25) AS hi, greatest(2, CAST(round_even(cnt * 0.4::DOUBLE, 0) AS INT)) AS ins FROM (
        SELECT shot_id AS id, start_s AS x, end_s AS y, duration_s, greatest(3, least(8, CAST(round_even(duration_s / 4, 0) AS INT))) AS cnt, start_s + duration_s * confidence * 0.5 AS best, CASE WHEN shot_index <> 2 THEN start_s + duration_s * confidence * 0.5 END AS raw FROM shots)))))""", "shots"),
    "k9_trim": oracle("""SELECT shot_id, x, y, x <= 0.05 AND (length IS NULL OR y >= length - 0.05) AS whole FROM (
        SELECT shot_id, length, greatest(0, f - 2) AS x, CASE WHEN length IS NULL THEN least(l, f + 30) + 2 ELSE least(length, least(l, f + 30) + 2) END AS y FROM (
            SELECT shot_id, CASE WHEN shot_type <> 'wide' THEN max(end_s) OVER (PARTITION BY source_id) END AS length, CASE WHEN top_pick THEN start_s + 1 ELSE start_s END AS f, CASE WHEN top_pick THEN end_s - 1 ELSE end_s END AS l FROM shots))""", "shots"),
    "k10_packing_list": oracle("""SELECT list, shot_id, pos, need, need * 10 AS bytes, sum(need * 10) OVER (PARTITION BY list ORDER BY pos, shot_id) <= 4000 AS taken FROM (
        SELECT job_id AS list, tokens % 12 AS shot_id, min(call_id) AS pos, max(tokens + 1) AS need FROM ledger GROUP BY ALL)""", "ledger"),
}
QUERIES = {k: v for k, v in list(globals().items()) if len(k) > 2 and k[0] in "fghjk" and k[1].isdigit()}
