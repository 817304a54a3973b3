"""Queries of indexes that are built, searched and kept in step over the given tables."""

import uuid

from pyspark.sql import functions as F

from shotlake.operators import quantised, segmented, usage, vector, versions
from shotlake.plans import search
from shotlake.sources import adapter
from shotlake.sources.adapter import oracle, read
from shotlake.sources.stages import shared_dir

#: Neighbours per query.
K = 20


def _unit(spark, d):
    return read(spark, d, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("doc"), vector.normalised(F.col("embedding")).alias("v"))


def _asked(spark, d):
    return _unit(spark, d).filter("doc % 20 = 0").select(F.col("doc").alias("query_id"), F.col("v").alias("q"))


def e8_approximate_knn(spark, d):
    """Every row whose id is divisible by 20 against all rows, through inverted lists of codes."""
    lists = quantised.measured(quantised.build(_unit(spark, d)), K)
    return quantised.search(lists, _asked(spark, d), K)


def e8_recall(spark, d):
    """Recall of e8 against the exact search, and the share of all pairs whose codes were looked at."""
    lists = quantised.measured(quantised.build(_unit(spark, d)), K)
    found, exact = quantised.search(lists, _asked(spark, d), K), vector.nearest(_asked(spark, d), lists.vectors, K)
    hits = exact.join(found.select("query_id", "doc", F.lit(1).alias("hit")), ["query_id", "doc"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall")).withColumn("compared", F.lit(round(quantised.compared(lists, _asked(spark, d), K), 4)))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _changes(spark, d):
    """Micro-batches of changes: all documents; French ones edited; Spanish ones deleted; German ones deleted and written again."""
    docs = search.docs(spark, d).select("doc_id", "text", "concept", "lang", F.lit(False).alias("deleted"), F.lit(1).alias("at"))
    gone = docs.filter("lang IN ('es', 'de')").withColumn("deleted", F.lit(True))
    return [
        docs.drop("lang"),
        docs.filter("lang = 'fr'").withColumn("text", F.concat_ws(" ", "text", F.lit("edited once"))).drop("lang"),
        gone.drop("lang"),
        gone.filter("lang = 'de'").withColumn("deleted", F.lit(False)).withColumn("text", F.lit("back again")).withColumn("at", F.lit(2)).unionByName(gone.filter("lang = 'de'")).drop("lang"),
    ]


def _index(spark, d):
    out = segmented.Segmented(spark, _folder(spark, "segments"), "doc_id", "long", search.COLUMNS, fan=3, smallest=100)
    for changes in _changes(spark, d):
        out.apply(changes)
    return out


def d3_in_step(spark, d):
    """d3's figures from an index that took in adds, edits and deletes, a segment at a time."""
    posts = _index(spark, d).postings()
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("tf"), 4).alias("tf"), F.max("in_first").alias("in_text"))


def a9_versions(spark, d):
    """Files as snapshots: all of them, then late ones indexed, small ones removed and a copy of each review added; counts by status of every version."""
    src = adapter.sources(spark, d).select("source_id", "status", "width", "created_at")
    table = versions.Versioned(spark, _folder(spark, "versions"), "source_id", 16)
    table.write(src)
    table.write(src.filter("status = 'pending'").withColumn("status", F.lit("indexed")).withColumn("created_at", F.lit(None).cast(src.schema["created_at"].dataType)), deleted=src.filter("width = 640"))
    table.write(src.filter("status = 'needs_review'").withColumn("source_id", F.concat("source_id", F.lit("-copy"))))
    parts = [table.read(v).groupBy("status").agg(F.count("*").alias("n"), F.sum("width").alias("width"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("newest")).withColumn("version", F.lit(v)) for v in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def m1_versions(spark, d):
    """The uses of shots as snapshots: project p1 takes over the list of p2 as a write of changes and deletions, and the version before is still there."""
    have = adapter.usage(spark, d).withColumn("id", F.concat_ws("|", "project", "shot_id"))
    want = have.filter("project = 'p2'").select("shot_id")
    table = versions.Versioned(spark, _folder(spark, "versions"), "id", 16)
    table.write(have)
    acts = usage.record(have, want, "p1", want.select("shot_id").distinct()).withColumn("id", F.concat_ws("|", "project", "shot_id"))
    added = acts.filter("action = 'added'").select("id", "shot_id", "project", F.lit(None).cast("string").alias("beat"), F.lit(None).cast(have.schema["used_at"].dataType).alias("used_at"))
    table.write(added, deleted=acts.filter("action = 'released'"))
    parts = [table.read(v).groupBy("project").agg(F.count("*").alias("uses"), F.count("used_at").alias("dated")).withColumn("version", F.lit(v)) for v in range(2)]
    return parts[0].unionByName(parts[1])


_CHANGED = f"""WITH changed AS (SELECT doc_id, CASE lang WHEN 'fr' THEN concat_ws(' ', text, 'edited once') WHEN 'de' THEN 'back again' ELSE text END AS text, lang, source FROM documents WHERE lang IS NULL OR lang <> 'es'), {search._BASE.replace('FROM documents', 'FROM changed')}"""
ORACLE: dict[str, str] = {
    "d3_in_step": f"{_CHANGED} SELECT term, count(*) AS df, round(sum(tf), 4) AS tf, bool_or(in_first) AS in_text FROM posts GROUP BY ALL",
    "a9_versions": oracle("""SELECT status, count(*) AS n, sum(width)::BIGINT AS width, strftime(max(created_at), '%Y-%m-%d') AS newest, v::INT AS version FROM (
        SELECT 0 AS v, status, width, created_at FROM sources
        UNION ALL SELECT v, CASE status WHEN 'pending' THEN 'indexed' ELSE status END, width, created_at FROM sources, (SELECT unnest([1, 2]) AS v) WHERE width <> 640
        UNION ALL SELECT 2, status, width, created_at FROM sources WHERE status = 'needs_review') GROUP BY ALL""", "sources"),
    "m1_versions": oracle("""SELECT project, count(*) AS uses, count(used_at) AS dated, v::INT AS version FROM (
        SELECT 0 AS v, project, used_at FROM usage UNION ALL SELECT 1, project, used_at FROM usage u WHERE project <> 'p1' OR EXISTS (SELECT 1 FROM usage w WHERE w.project = 'p2' AND w.shot_id = u.shot_id)
        UNION ALL SELECT 1, 'p1', NULL FROM usage w WHERE project = 'p2' AND NOT EXISTS (SELECT 1 FROM usage u WHERE u.project = 'p1' AND u.shot_id = w.shot_id)) GROUP BY ALL""", "usage"),
}
QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abdeklmp" and k[1:2].isdigit()}
