"""Queries of folder matching, search results, review lists and set operations over the adapted tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.operators import facets, filters, folders, hybrid, vector
from shotlake.plans import search
from shotlake.sources import adapter
from shotlake.sources.adapter import oracle, read


def _written(spark, d):
    """Folders as written: exact, by another spelling, by the last part only, or unknown."""
    k = F.col("source_id").cast("long") % 4
    s = adapter.sources(spark, d)
    last = F.element_at(F.split("category", "/"), -1)
    return s.select("source_id", F.when(k == 0, F.col("category")).when(k == 1, F.lower(F.regexp_replace("category", "/", " / "))).when(k == 2, last).otherwise(F.lit("Nowhere")).alias("written"))


def _leaves(spark, d):
    return adapter.sources(spark, d).select(F.col("category").alias("path")).distinct()


def b8_match_folder(spark, d):
    return folders.match(_written(spark, d), _leaves(spark, d), "source_id")


def b9_near_names(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("parent"), F.concat(F.lit("Place "), F.col("s_suppkey") % 9, F.when(F.col("s_suppkey") % 2 == 0, "s").when(F.col("s_suppkey") % 5 == 0, " North").otherwise("")).alias("name")).distinct()
    return folders.near(s)


def b14_photo_override(spark, d):
    s = adapter.shots(spark, d).join(adapter.sources(spark, d).select("source_id", "media_kind"), "source_id")
    return s.select("shot_id", F.when(F.col("media_kind") == "image", "static").otherwise(F.col("camera_movement")).alias("camera_movement"))


def b22_embedding_text(spark, d):
    s = adapter.shots(spark, d)
    return s.select("shot_id", F.array_join(folders.distinct_any_case(F.concat(F.array("caption", F.upper("action"), "action"), "tags", "mood")), ", ").alias("text"))


def c5_unfiled(spark, d):
    s = adapter.sources(spark, d).withColumn("category", F.when(F.col("width") == 640, None).otherwise(F.col("category")))
    return filters.where(s, {"unfiled": True}).select("source_id")


def _filter_specs(spark, d):
    """A specification per supplier, each of other parts."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    words = lambda *v: F.array(*map(F.lit, v))
    kinds = F.when(k % 4 == 1, F.create_map(F.lit("shot_type"), words("wide"))).when(k % 4 == 2, F.create_map(F.lit("mood"), words("calm"), F.lit("camera_movement"), words("pan", "tilt"))).when(k % 4 == 3, F.create_map(F.lit("tags"), words("red", "blue"), F.lit("shot_type"), words("wide", "medium")))
    return s.select(
        k.alias("spec"), kinds.alias("any_of"),
        F.when(k % 5 == 0, F.create_map(F.lit("duration_s"), (k % 30).cast("double"))).when(k % 7 == 0, F.create_map(F.lit("width"), F.lit(1280.0), F.lit("created_at"), F.lit("1995-01-01").cast("timestamp").cast("double"))).alias("at_least"),
        F.when(k % 6 == 0, F.create_map(F.lit("duration_s"), F.lit(40.0))).when(k % 9 == 1, F.create_map(F.lit("created_at"), F.lit("1996-01-01").cast("timestamp").cast("double"))).alias("at_most"),
        F.when(k % 9 == 0, F.create_map(F.lit("top_pick"), F.lit(True))).alias("is_flag"), F.when(k % 2 == 0, F.array(F.concat_ws("/", "r_name", "n_name"), F.lit("EUROPE/none"))).alias("folders"), (k % 10 == 0).alias("direct"), (k % 4 == 0).alias("primary_only"),
        (k % 31 == 30).alias("unfiled"), F.when(k % 8 == 1, words("shaky")).alias("all_flags"), F.when(k % 8 == 2, words("dark", "blurred")).alias("no_flags"), (k % 13 == 3).alias("clean"), F.when(k % 12 == 5, words("failed")).when(k % 12 == 7, words()).alias("status"), F.lit(None).cast("array<string>").alias("exclude"), F.when(k % 4 == 3, F.array(F.concat(F.lit("p"), (k % 20).cast("string")))).alias("exclude_lists"),
    )


def c11_filter_table(spark, d):
    """Every filter of C1 to C10, combined in a row per specification, against all shots at once."""
    src = adapter.sources(spark, d).select("source_id", "media_kind", "width", F.col("created_at").cast("timestamp").cast("double").alias("created_at"), "category", F.array(F.regexp_replace("category", "^[^/]+", "ASIA")).alias("secondary"))
    used = adapter.usage(spark, d).groupBy("shot_id").agg(F.collect_set("project").alias("exclude_lists"))
    shots = adapter.shots(spark, d).join(src, "source_id").join(used, "shot_id", "left")
    rows = filters.shot_tokens(shots, ["shot_type", "camera_movement", "action", "setting", "status", "media_kind"], ["tags", "mood"], ["duration_s", "width", "created_at"], ["top_pick"])
    return filters.matches(rows, _filter_specs(spark, d)).select("spec", F.col("doc").alias("shot_id"))


def d4_document_frequency(spark, d):
    """Documents whose text has the term: the index tells which terms stand in the first column."""
    return search._index(spark, d).first_frequencies()


def e6_latest_vectors(spark, d):
    e = read(spark, d, "embeddings")
    versions = e.select("vec_id", "embedding", F.lit(1).alias("at")).union(e.filter("vec_id % 3 = 0").select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 5)).otherwise(F.reverse("embedding")), F.lit(2)))
    fit, _ = vector.valid_vectors(versions, "embedding", 64)
    return vector.latest_vectors(fit, "vec_id", "at").select("vec_id", "at", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def f2_gate(spark, d):
    c = adapter.ledger(spark, d).select(F.col("workspace_id").alias("query_id"), F.col("call_id").alias("doc"), (F.col("tokens") % 10 / 10).alias("coverage"), (F.col("tokens") % 4).alias("found"), F.lit(3).alias("words"), F.when(F.col("kind") != "error", F.col("tokens") / 100).alias("similarity"), F.lit(0.6).alias("floor"), F.lit(0.13).alias("gap"), F.lit(0.55).alias("near_floor"), F.lit(0.19).alias("near_gap"), (F.col("kind") == "view").alias("adaptive"))
    return hybrid.gate(c).groupBy("query_id", "label").agg(F.count("*").alias("n"))


def f5_browse(spark, d):
    s = adapter.shots(spark, d).join(adapter.sources(spark, d).select("source_id", "created_at"), "source_id")
    return s.orderBy(F.desc("created_at"), "shot_index", "shot_id").offset(20).limit(30).select("shot_id", "created_at")


def f9_sure_then_near(spark, d):
    l = adapter.ledger(spark, d).withColumn("sure", F.col("cost_usd") > 100)
    w = W.partitionBy("job_id").orderBy(F.desc("sure"), F.desc("cost_usd"), "call_id")
    return l.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("job_id", "place", "call_id", "sure")


def g7_direct_counts(spark, d):
    """Files filed in each folder, and those that lie elsewhere but fit there too."""
    s = adapter.sources(spark, d).select("source_id", "category", F.array(F.regexp_replace("category", "^[^/]+", "ASIA"), F.regexp_extract("category", "^[^/]+", 0), F.lit("ASIA")).alias("secondary"))
    return facets.folder_counts(s)


def g7_quick_counts(spark, d):
    s = adapter.shots(spark, d).join(adapter.sources(spark, d).select("source_id", "workspace_id", F.when(F.col("width") != 640, F.col("category")).alias("category"), (F.col("width") > 1280).alias("featured")), "source_id")
    return s.groupBy("workspace_id").agg(*facets.quick_counts())


def g23_review_queue(spark, d):
    s = adapter.shots(spark, d).filter("status = 'needs_review'")
    reasons = F.array_compact(F.array(F.when(F.size("quality_flags") > 0, F.concat(F.lit("flags: "), F.array_join("quality_flags", ", "))), F.when(F.col("confidence") < 0.6, F.concat(F.lit("confidence "), F.format_string("%.2f", "confidence")))))
    return s.select("shot_id", F.array_join(F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("look again"))), "; ").alias("reasons"))


def g24_attention(spark, d):
    return adapter.sources(spark, d).filter("status <> 'indexed'").groupBy(F.coalesce("media_kind", F.lit("other")).alias("side"), "status").agg(F.count("*").alias("n"), F.sum("filesize_bytes").alias("bytes"))


def h5_clock(spark, d):
    e = adapter.shots(spark, d)
    w = W.partitionBy("source_id").orderBy("shot_index").rowsBetween(W.unboundedPreceding, -1)
    return e.select("shot_id", F.coalesce(F.sum("duration_s").over(w), F.lit(0.0)).alias("start"))


def i4_attach_ids(spark, d):
    s = adapter.sources(spark, d)
    return s.join(s.filter("width > 1280").select("source_id"), "source_id", "left_anti").join(s.select(F.col("content_hash"), F.col("source_id").alias("o")).groupBy("content_hash").agg(F.min("o").alias("original")), "content_hash", "left").select("source_id", "original")


def i6_allowed(spark, d):
    return adapter.usage(spark, d).join(filters.where(adapter.shots(spark, d), {"in": {"shot_type": ["wide"]}}), "shot_id", "left_semi").select("shot_id", "project")


def i10_tags_of(spark, d):
    t = adapter.shots(spark, d).select("shot_id", F.explode("tags").alias("tag"))
    return adapter.shots(spark, d).filter("shot_index = 0").select("shot_id").join(t, "shot_id").groupBy("shot_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))


def i12_owners(spark, d):
    u = adapter.usage(spark, d).select(F.split("shot_id", "-")[0].alias("source_id"), "shot_id").distinct()
    return u.join(adapter.sources(spark, d), "source_id").groupBy("shot_id").agg(F.min("workspace_id").alias("owner"))


def j8_client_tree(spark, d):
    """A tree in which European folders are no leaves, split by kind of media."""
    src = adapter.sources(spark, d).select("source_id", "category", "status", F.when(F.col("media_kind") == "image", "Images").otherwise("Videos").alias("prefix"))
    shots = adapter.shots(spark, d).drop("status").join(src, "source_id").withColumn("doubt", (F.col("status") == "needs_review") & (F.col("shot_index") % 3 != 1)).withColumn("secondary", F.array(F.regexp_replace("category", "^[^/]+", "ASIA"), F.lit("no such")))
    return folders.client_tree(shots, _leaves(spark, d).filter("path NOT LIKE 'EUROPE/%'"))


def j18_approve(spark, d):
    s = adapter.sources(spark, d)
    return folders.approve(s.select("source_id", "category", "status", (F.col("width") == 640).alias("corrected")), s.filter("width < 1920").select("source_id", F.lit("NEW/PLACE").alias("to")))


def l11_rerank(spark, d):
    """An external ranking names places of a shortlist; bad and repeated ones are ignored, the rest follow in order."""
    e = adapter.ledger(spark, d)
    w = W.partitionBy("job_id").orderBy(F.desc("cost_usd"), "call_id")
    short = e.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("job_id", "rank", "call_id")
    choice = e.withColumn("pos", F.row_number().over(W.partitionBy("job_id").orderBy("call_id"))).filter("pos <= 4").select("job_id", "pos", (F.col("tokens") % 8).cast("int").alias("rank"))
    return folders.rerank(short, choice)


def n4_sync_summary(spark, d):
    s = adapter.shots(spark, d)
    return s.agg(F.count_if(F.col("shot_index") == 3).alias("new"), F.count_if(F.col("shot_index") == 1).alias("changed"), F.count_if(~F.col("shot_index").isin(1, 3)).alias("same"))


def o1_folder_union(spark, d):
    s = adapter.sources(spark, d)
    return s.select("source_id", F.explode(F.array_union(F.array("category"), F.array(F.regexp_replace("category", "^[^/]+", "ASIA")))).alias("folder")).distinct()


def o4_ordered_distinct(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


ORACLE = {
    "b8_match_folder": oracle("""SELECT source_id, CASE WHEN CAST(source_id AS BIGINT) % 4 < 2 THEN category WHEN CAST(source_id AS BIGINT) % 4 = 2 AND (SELECT count(DISTINCT category) FROM sources x WHERE split_part(x.category, '/', 3) = split_part(s.category, '/', 3)) = 1 THEN category END AS path FROM sources s""", "sources"),
    "b9_near_names": """WITH s AS (SELECT DISTINCT s_nationkey AS parent, 'Place ' || (s_suppkey % 9) || CASE WHEN s_suppkey % 2 = 0 THEN 's' WHEN s_suppkey % 5 = 0 THEN ' North' ELSE '' END AS name FROM supplier),
        q AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM s)
        SELECT a.parent, a.name, b.name AS near FROM q a JOIN q b ON a.parent = b.parent AND a.name < b.name AND (rtrim(a.k, 's') = rtrim(b.k, 's') OR contains(a.k, b.k) OR contains(b.k, a.k))""",
    "b14_photo_override": oracle("SELECT shot_id, CASE WHEN media_kind = 'image' THEN 'static' ELSE camera_movement END AS camera_movement FROM shots JOIN sources USING (source_id)", "sources", "shots"),
    "b22_embedding_text": oracle("""SELECT shot_id, caption || ', ' || upper(action) || list_reduce(list_prepend('', list_filter(list_distinct_o, lambda t: t <> action)), lambda a, b: a || ', ' || b) AS text FROM (SELECT *, list_concat(tags, mood) AS list_distinct_o FROM shots)""", "shots"),
    "c5_unfiled": oracle("SELECT source_id FROM sources WHERE width = 640 AND status IN ('indexed', 'needs_review')", "sources"),
    "c11_filter_table": oracle("""SELECT s_suppkey AS spec, shot_id FROM (SELECT sh.*, media_kind, width, created_at, category, [regexp_replace(category, '^[^/]+', 'ASIA')] AS sec FROM shots sh JOIN sources USING (source_id)) x,
        (SELECT *, s_suppkey AS k, r_name || '/' || n_name AS f, s_suppkey % 4 = 0 AS prim, s_suppkey % 10 = 0 AS direct FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) y
        WHERE CASE k % 12 WHEN 5 THEN status = 'failed' WHEN 7 THEN TRUE ELSE status IN ('indexed', 'needs_review') END
        AND CASE k % 4 WHEN 1 THEN shot_type = 'wide' WHEN 2 THEN list_contains(mood, 'calm') AND camera_movement IN ('pan', 'tilt') WHEN 3 THEN list_has_any(tags, ['red', 'blue']) AND shot_type IN ('wide', 'medium') ELSE TRUE END
        AND (k % 5 <> 0 OR duration_s >= k % 30 OR coalesce(media_kind = 'image', FALSE)) AND (k % 5 = 0 OR k % 7 <> 0 OR (width >= 1280 AND created_at >= TIMESTAMP '1995-01-01'))
        AND (k % 6 <> 0 OR duration_s <= 40 OR coalesce(media_kind = 'image', FALSE)) AND (k % 6 = 0 OR k % 9 <> 1 OR created_at <= TIMESTAMP '1996-01-01')
        AND (k % 9 <> 0 OR top_pick) AND (k % 2 <> 0 OR category = f OR (NOT direct AND starts_with(category, f || '/')) OR (NOT prim AND (sec[1] = f OR (NOT direct AND starts_with(sec[1], f || '/')))))
        AND (k % 31 <> 30 OR category IS NULL) AND (k % 8 <> 1 OR list_contains(quality_flags, 'shaky')) AND (k % 8 <> 2 OR NOT list_has_any(quality_flags, ['dark', 'blurred'])) AND (k % 13 <> 3 OR len(quality_flags) = 0)
        AND NOT (k % 4 = 3 AND EXISTS (SELECT 1 FROM usage u WHERE u.shot_id = x.shot_id AND u.project = 'p' || (k % 20)))""", "sources", "shots", "usage"),
    "d4_document_frequency": "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL",
    "e6_latest_vectors": "SELECT vec_id, CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 1 THEN 2 ELSE 1 END AS at_, round((CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 1 THEN embedding[64] ELSE embedding[1] END)::DOUBLE, 6) AS first FROM embeddings".replace("at_", '"at"'),
    "f2_gate": oracle("""SELECT query_id, label, count(*) AS n FROM (SELECT query_id, CASE WHEN sim IS NULL THEN CASE WHEN lit THEN 'match' WHEN cov > 0 THEN 'near' ELSE 'weak' END WHEN lit THEN 'match' WHEN cov >= 0.25 AND sim >= 0.6 THEN 'match'
        WHEN sim >= 0.6 AND (ad OR sim >= best - 0.13) THEN 'match' WHEN cov >= 0.25 OR (sim >= 0.55 AND sim >= best - 0.19) THEN 'near' ELSE 'weak' END AS label FROM (
        SELECT workspace_id AS query_id, tokens % 10 / 10 AS cov, tokens % 10 >= 5 AND tokens % 4 >= 2 AS lit, CASE WHEN kind <> 'error' THEN tokens / 100 END AS sim, kind = 'view' AS ad, max(CASE WHEN kind <> 'error' THEN tokens / 100 END) OVER (PARTITION BY workspace_id) AS best FROM ledger)) GROUP BY ALL""", "ledger"),
    "f5_browse": oracle("SELECT shot_id, created_at FROM shots JOIN sources USING (source_id) ORDER BY created_at DESC, shot_index, shot_id LIMIT 30 OFFSET 20", "sources", "shots"),
    "f9_sure_then_near": oracle("SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY cost_usd > 100 DESC, cost_usd DESC, call_id) AS place, call_id, cost_usd > 100 AS sure FROM ledger QUALIFY place <= 5", "ledger"),
    "g7_direct_counts": oracle("""SELECT coalesce(a.folder, b.folder) AS folder, coalesce(direct, 0) AS direct, coalesce(also, 0) AS also FROM (SELECT category AS folder, count(*) AS direct FROM sources GROUP BY ALL) a
        FULL JOIN (SELECT folder, count(*) AS also FROM (SELECT DISTINCT source_id, category, unnest([regexp_replace(category, '^[^/]+', 'ASIA'), split_part(category, '/', 1), 'ASIA']) AS folder FROM sources) WHERE category <> folder AND NOT starts_with(category, folder || '/') GROUP BY ALL) b ON a.folder = b.folder""", "sources"),
    "g7_quick_counts": oracle("SELECT workspace_id, count(*) AS total, count_if(top_pick) AS top_picks, count_if(width > 1280) AS featured, count_if(width = 640) AS unsorted, count_if(s.status = 'needs_review') AS review FROM shots s JOIN sources USING (source_id) GROUP BY ALL", "sources", "shots"),
    "g23_review_queue": oracle("""SELECT shot_id, coalesce(nullif(concat_ws('; ', CASE WHEN len(quality_flags) > 0 THEN 'flags: ' || array_to_string(quality_flags, ', ') END, CASE WHEN confidence < 0.6 THEN 'confidence ' || format('{:.2f}', confidence) END), ''), 'look again') AS reasons FROM shots WHERE status = 'needs_review'""", "shots"),
    "g24_attention": oracle("SELECT coalesce(media_kind, 'other') AS side, status, count(*) AS n, sum(filesize_bytes)::BIGINT AS bytes FROM sources WHERE status <> 'indexed' GROUP BY ALL", "sources"),
    "h5_clock": oracle("SELECT shot_id, start_s AS start FROM shots", "shots"),
    "i4_attach_ids": oracle("SELECT source_id, original FROM sources JOIN (SELECT content_hash, min(source_id) AS original FROM sources GROUP BY ALL) USING (content_hash) WHERE width <= 1280", "sources"),
    "i6_allowed": oracle("SELECT shot_id, project FROM usage WHERE shot_id IN (SELECT shot_id FROM shots WHERE shot_type = 'wide' AND status IN ('indexed', 'needs_review'))", "shots", "usage"),
    "i10_tags_of": oracle("SELECT shot_id, array_to_string(list_sort(tags), ',') AS tags FROM shots WHERE shot_index = 0", "shots"),
    "i12_owners": oracle("SELECT shot_id, workspace_id AS owner FROM (SELECT DISTINCT shot_id FROM usage) JOIN sources ON source_id = split_part(shot_id, '-', 1)", "sources", "usage"),
    "j8_client_tree": oracle(""", x AS (SELECT s.shot_id, s.source_id, shot_index, s.duration_s, top_pick, category, regexp_replace(category, '^[^/]+', 'ASIA') AS sec, CASE WHEN media_kind = 'image' THEN 'Images' ELSE 'Videos' END AS prefix, src.status = 'needs_review' AND shot_index % 3 <> 1 AS doubt FROM shots s JOIN sources src USING (source_id)),
        firsts AS (SELECT source_id, prefix, doubt, CASE WHEN NOT doubt AND category NOT LIKE 'EUROPE/%' THEN category END AS home FROM x QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY duration_s DESC, shot_index) = 1)
        SELECT source_id, prefix || '/' || CASE WHEN doubt THEN 'To review' ELSE coalesce(home, 'Unsorted') END AS folder, 'home' AS why, NULL::VARCHAR AS shot_id FROM firsts
        UNION SELECT a.source_id, a.prefix || '/' || f, 'also', a.shot_id FROM (SELECT *, unnest([category, sec]) AS f FROM x WHERE NOT doubt) a JOIN firsts h ON h.source_id = a.source_id WHERE f IN (SELECT category FROM sources WHERE category NOT LIKE 'EUROPE/%') AND f IS DISTINCT FROM h.home
        UNION SELECT source_id, prefix || '/Top picks', 'pick', shot_id FROM x WHERE top_pick""", "sources", "shots"),
    "j18_approve": oracle("SELECT source_id, CASE WHEN width = 1280 THEN 'NEW/PLACE' ELSE category END AS category, CASE WHEN width = 1280 AND status = 'needs_review' THEN 'indexed' ELSE status END AS status FROM sources", "sources"),
    "l11_rerank": oracle("""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY pos IS NULL, pos, rank) AS place, call_id FROM (SELECT job_id, call_id, row_number() OVER (PARTITION BY job_id ORDER BY cost_usd DESC, call_id) AS rank FROM ledger) s
        LEFT JOIN (SELECT job_id, rank, min(pos) AS pos FROM (SELECT job_id, CAST(tokens % 8 AS INT) AS rank, row_number() OVER (PARTITION BY job_id ORDER BY call_id) AS pos FROM ledger) WHERE pos <= 4 GROUP BY ALL) c USING (job_id, rank) WHERE rank <= 5""", "ledger"),
    "n4_sync_summary": oracle("SELECT count_if(shot_index = 3) AS new, count_if(shot_index = 1) AS changed, count_if(shot_index NOT IN (1, 3)) AS same FROM shots", "shots"),
    "o1_folder_union": oracle("SELECT source_id, category AS folder FROM sources UNION SELECT source_id, regexp_replace(category, '^[^/]+', 'ASIA') FROM sources", "sources"),
    "o4_ordered_distinct": "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY ALL",
}
QUERIES = {k: v for k, v in list(globals().items()) if len(k) > 2 and k[0] in "bcdefghijlno" and k[1].isdigit()}
