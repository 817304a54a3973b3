"""Where shots were used, how files match, and what a downstream copy lacks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def match_files(local: DataFrame, originals: DataFrame, indexed: DataFrame) -> DataFrame:
    """local (id, name, md5, size) to originals (orig_id, orig_name, md5, size), indexed (orig_id): id, orig_id, renamed, identical, status.

    Of the originals of a content that of the same name (in any case) comes first, then the least id; identical says how many there are. The
    first local file by id has its original: matched, or already_indexed; others of it are duplicate; those without one, or without md5 or
    size, unmatched. Originals are one row for each content, and for each content and name, so files never meet all of a content.
    """
    known = (F.coalesce("md5", F.lit("")) != "") & (F.col("size") > 0)
    key = [F.lower("md5").alias("md5"), "size"]
    right = originals.filter(known).select(*key, "orig_id", "orig_name")
    any_ = right.groupBy("md5", "size").agg(F.min(F.struct("orig_id", "orig_name")).alias("any"), F.count("*").alias("identical"))
    named = right.groupBy("md5", "size", F.lower("orig_name").alias("_n")).agg(F.min(F.struct("orig_id", "orig_name")).alias("same"))
    found = local.filter(known).select("id", "name", *key, F.lower("name").alias("_n")).join(any_, ["md5", "size"]).join(named, ["md5", "size", "_n"], "left").withColumn("x", F.coalesce("same", "any")).select("id", "name", "x.*", "identical")
    first = found.groupBy("orig_id").agg(F.min("id").alias("first"))
    done = indexed.select("orig_id", F.lit(True).alias("done")).distinct()
    status = F.when(F.col("id") != F.col("first"), "duplicate").when(F.col("done"), "already_indexed").otherwise("matched")
    placed = found.join(first, "orig_id").join(done, "orig_id", "left").select("id", "orig_id", (F.col("name") != F.col("orig_name")).alias("renamed"), "identical", status.alias("status"))
    return local.select("id").join(placed, "id", "left").select("id", "orig_id", "renamed", "identical", F.coalesce("status", F.lit("unmatched")).alias("status"))


def history(shots: DataFrame, used: DataFrame, most: int) -> DataFrame:
    """shot_id, uses, and the projects of the most recent ones, newest first."""
    newest = W.partitionBy("shot_id").orderBy(F.desc("used_at"), "project")
    rows = used.withColumn("r", F.row_number().over(newest))
    per = rows.groupBy("shot_id").agg(F.count("*").alias("uses"), F.sort_array(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "project")))).alias("x"))
    return shots.select("shot_id").join(per, "shot_id", "left").select("shot_id", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce(F.array_join(F.transform("x", lambda s: s["project"]), ","), F.lit("")).alias("recent"))


def frames_in_window(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """frames (shot_id, t) inside their shot's window (lo, hi); all of a shot's frames if none is."""
    inside = F.col("t").between(F.col("lo"), F.col("hi"))
    j = frames.join(windows, "shot_id").withColumn("_in", inside).withColumn("_any", F.max("_in").over(W.partitionBy("shot_id")))
    return j.filter(F.col("_in") | ~F.col("_any")).select("shot_id", "t")


def _plain(name: Column) -> Column:
    return F.lower(F.trim(name))


def _slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def find_library(asked: DataFrame, libraries: DataFrame, key: str) -> DataFrame:
    """asked (key, q): the library by id, else by name, else by slug."""
    by = lambda name, expr: libraries.select(expr.alias("_k"), F.col("id").alias(name)).groupBy("_k").agg(F.min(name).alias(name))
    out = asked
    for name, mine, theirs in (("a", F.col("q"), F.col("id")), ("b", _plain(F.col("q")), _plain(F.col("name"))), ("c", _slug(F.col("q")), _slug(F.col("name")))):
        out = out.join(by(name, theirs), mine == F.col("_k"), "left").drop("_k")
    return out.select(key, F.coalesce("a", "b", "c").alias("id"))


def record(used: DataFrame, wanted: DataFrame, project: str, shots: DataFrame) -> DataFrame:
    """What replacing a project's list by `wanted` does to each shot: added, kept, released, or unknown."""
    have = used.filter(F.col("project") == project).select("shot_id", F.lit(True).alias("have"))
    j = have.join(wanted.select("shot_id", F.lit(True).alias("want")), "shot_id", "full_outer").join(shots.select("shot_id", F.lit(True).alias("known")), "shot_id", "left")
    action = F.when(F.col("want").isNull(), "released").when(F.col("known").isNull(), "unknown").when(F.col("have").isNull(), "added").otherwise("kept")
    return j.select(F.lit(project).alias("project"), "shot_id", action.alias("action"))


def in_project(used: DataFrame, project: str, except_beat: str | None = None) -> DataFrame:
    """Shots used in a project, but for those on one beat; a use without a beat counts for all."""
    rows = used.filter(F.col("project") == project)
    if except_beat is not None:
        rows = rows.filter(F.col("beat").isNull() | (F.col("beat") != except_beat))
    return rows.select("shot_id").distinct()


def since(used: DataFrame, at: str, other_than: str) -> DataFrame:
    return used.filter((F.col("used_at") >= F.lit(at).cast("timestamp")) & (F.col("project") != other_than)).select("shot_id").distinct()


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint): SHA-1 of the row as JSON, columns in order of name."""
    return rows.select(key, F.sha1(F.to_json(F.struct(*sorted(c for c in rows.columns if c != key)))).alias("fingerprint"))


def changes(now: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Rows new or changed since they were sent."""
    j = now.join(sent.select(key, F.col("fingerprint").alias("was")), key, "left")
    return j.filter(~F.col("fingerprint").eqNullSafe(F.col("was"))).select(key, F.when(F.col("was").isNull(), "new").otherwise("changed").alias("change"))


def prune(now: DataFrame, sent: DataFrame, key: str, least: int = 20, share: float = 0.3) -> DataFrame:
    """How many sent rows are stale, and whether removing them is refused: too many, or nothing is current."""
    j = sent.select(key).join(now.select(key, F.lit(1).alias("_now")), key, "full_outer").join(sent.select(key, F.lit(1).alias("_sent")), key, "left")
    stale, total, current = F.count_if(F.col("_now").isNull()), F.count_if(F.col("_sent").isNotNull()), F.count_if(F.col("_now").isNotNull())
    return j.agg(stale.alias("stale"), total.alias("sent"), current.alias("current")).withColumn("refused", (F.col("stale") > F.greatest(F.lit(float(least)), share * F.col("sent"))) | (F.col("current") == 0))
