"""Folder placement: names, planned folders, reconciliation with what exists, edits of the tree."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.operators.facets import ancestors


def label(v: Column) -> Column:
    """Words with a capital first letter, the rest as it is."""
    return F.array_join(F.transform(F.split(F.regexp_replace(v, "[_-]+", " "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 200))), " ")


def slug(v: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", "_"), F.lit("_"))


def file_name(parts: list[Column], digest: Column, ext: Column, budget: int = 60) -> Column:
    """Parts as slugs within a budget, then 8 characters of the hash: the same for the same content."""
    stem = F.rtrim(F.substring(F.array_join(F.filter(F.array(*(slug(p) for p in parts)), lambda p: p != ""), "_"), 1, budget), F.lit("_"))
    return F.concat(stem, F.lit("_"), F.substring(digest, 1, 8), ext)


def with_timecode(name: Column, start: Column, primary: Column) -> Column:
    """The name, with minutes and seconds before its ending unless the shot is its file's primary one."""
    clock = F.format_string("_%02dm%02ds", F.floor(start / 60).cast("int"), F.floor(start % 60).cast("int"))
    return F.when(primary, name).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), clock, F.regexp_extract(name, r"(\.[^.]*)$", 1)))


def top_values(counts: DataFrame, most: int) -> DataFrame:
    """counts (facet, value, n) -> with folder: the value if it earns one, else Other. Facets with few values keep them all."""
    order = W.partitionBy("facet").orderBy(F.desc("n"), "value")
    rows = counts.withColumn("_r", F.row_number().over(order)).withColumn("_k", F.count("*").over(W.partitionBy("facet")))
    return rows.withColumn("folder", F.when((F.col("_k") <= most) | (F.col("_r") <= most), F.col("value")).otherwise("Other")).drop("_r", "_k")


def third_level(pairs: DataFrame, least: int) -> DataFrame:
    """pairs (a, b, n): for each a the b it is split by: most shots, first by name; none below `least`."""
    order = W.partitionBy("a").orderBy(F.desc("n"), "b")
    return pairs.filter(F.col("n") >= least).withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("a", "b", "n")


def distinct_names(placed: DataFrame) -> DataFrame:
    """placed (folder, name, source_id): later files of one folder and name get _dup2, _dup3 before the ending."""
    k = F.row_number().over(W.partitionBy("folder", "name").orderBy("source_id"))
    return placed.withColumn("_k", k).select("folder", F.when(F.col("_k") == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_dup"), F.col("_k").cast("string"), F.regexp_extract("name", r"(\.[^.]*)$", 1))).alias("name"), "source_id")


def folders_to_create(paths: DataFrame) -> DataFrame:
    """(path, depth) of every folder on the way to a path."""
    return paths.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select("path", F.size(F.split("path", "/")).alias("depth"))


def reconcile(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """desired and actual (folder, name, source_id) -> action: create, keep, conflict (other file there), delete."""
    j = desired.withColumnRenamed("source_id", "want").join(actual.withColumnRenamed("source_id", "have"), ["folder", "name"], "full_outer")
    action = F.when(F.col("have").isNull(), "create").when(F.col("want").isNull(), "delete").when(F.col("have") == F.col("want"), "keep").otherwise("conflict")
    return j.select("folder", "name", "want", "have", action.alias("action"))


def under(path: Column, prefix: str) -> Column:
    return (path == prefix) | path.startswith(prefix + "/")


def renamed(path: Column, old: str, new: str) -> Column:
    return F.when(under(path, old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def removed(rows: DataFrame, path: str, to: str | None) -> DataFrame:
    """rows (category, secondary) after a folder is gone: moved, or unfiled and flagged; secondary folders drop it, two at most stay."""
    gone = F.coalesce(under(F.col("category"), path), F.lit(False))
    second = F.slice(F.array_distinct(F.filter(F.transform("secondary", lambda s: F.when(under(s, path), F.lit(to)).otherwise(s)), lambda s: s.isNotNull())), 1, 2)
    return rows.withColumn("flagged", gone & F.lit(to is None)).withColumn("secondary", second).withColumn("category", F.when(gone, F.lit(to)).otherwise(F.col("category")))


def refile(proposals: DataFrame, least: float = 0.6) -> DataFrame:
    """proposals (id, before, after, confidence, known): move, unchanged, tie (too unsure) or unmatched (no such folder)."""
    action = F.when(F.col("after").isNull() | ~F.col("known"), "unmatched").when(F.col("after").eqNullSafe(F.col("before")), "unchanged").when(F.col("confidence") < least, "tie").otherwise("move")
    return proposals.withColumn("action", action)


def merge_attention(stored: DataFrame, flags: DataFrame) -> DataFrame:
    """stored (key, status, size_bytes) with flags (key, size_bytes): new keys open, closed ones open again, dismissed ones stay; known sizes stay."""
    j = stored.alias("s").join(flags.groupBy("key").agg(F.max("size_bytes").alias("size_bytes"), F.lit(True).alias("flag")).alias("f"), "key", "full_outer")
    status = F.when(F.col("s.status").isNull(), "open").when(F.col("s.status") == "dismissed", "dismissed").when(F.col("f.flag"), "open").otherwise(F.col("s.status"))
    return j.select("key", status.alias("status"), F.coalesce("f.size_bytes", "s.size_bytes").alias("size_bytes"))


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """nodes (path, note) -> depth, leaf, and notes inherited from the folders above, outermost first."""
    up = nodes.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(nodes.select(F.col("path").alias("above"), F.col("note").alias("n")), "above").filter("n is not null")
    notes = up.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("above").alias("l"), "n"))), lambda x: x["n"]), "; ").alias("notes"))
    parents = nodes.select(F.regexp_extract("path", "^(.*)/", 1).alias("path")).distinct().withColumn("_p", F.lit(True))
    return nodes.join(notes, "path", "left").join(parents, "path", "left").select("path", F.size(F.split("path", "/")).alias("depth"), F.col("_p").isNull().alias("leaf"), F.coalesce("notes", F.lit("")).alias("notes"))
