"""Catalogue scans, keyed lookups, upserts, removals, duplicates and derived statuses."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.sources.stages import keep

#: File name endings by kind.
VIDEO = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".mts", ".m2ts", ".mxf", ".wmv")
IMAGE = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".tif", ".tiff", ".avif", ".bmp")
RAW = (".nef", ".nrw", ".arw", ".srf", ".sr2", ".cr2", ".cr3", ".crw", ".dng", ".raf", ".orf", ".rw2", ".pef", ".srw", ".x3f", ".3fr", ".erf", ".mef", ".mrw", ".kdc", ".dcr")


def newest(rows: DataFrame, at: str, key: str, limit: int | None = None, status: str | None = None) -> DataFrame:
    """Rows newest first, optionally of one status, optionally limited; ties by key."""
    rows = rows if status is None else rows.filter(F.col("status") == status)
    rows = rows.orderBy(F.desc(at), key)
    return rows if limit is None else rows.limit(limit)


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in keys, in one semi join."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def media_kind(name: Column) -> Column:
    """video, image or null by file name; names that start with `._` are stubs."""
    ext = F.regexp_extract(F.lower(name), r"(\.[^.]+)$", 1)
    return F.when(name.startswith("._"), None).when(ext.isin(*VIDEO), "video").when(ext.isin(*IMAGE, *RAW), "image")


def with_paths(listing: DataFrame) -> DataFrame:
    """listing (id, parent, name): full path of each entry under a root, by joining parents level by level until none is left.

    Levels are written stages. Entries that stand in a circle have no root and no path; an id is placed once.
    """
    level = keep(listing.filter(F.col("parent").isNull()).select("id", "name", F.col("name").alias("path")), "paths")
    done = level
    while True:
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        level = keep(listing.join(above, "parent").select("id", "name", F.concat_ws("/", "above", "name").alias("path")).join(done.select("id"), "id", "left_anti"), "paths")
        if level.isEmpty():
            return done
        done = done.unionByName(level)


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """base with updates laid over it: a null in updates keeps what was there; new keys are added."""
    cols = [c for c in base.columns if c != key]
    joined = base.alias("b").join(updates.alias("u"), key, "full_outer")
    return joined.select(key, *(F.coalesce(F.col(f"u.{c}"), F.col(f"b.{c}")).alias(c) if c in updates.columns else F.col(f"b.{c}").alias(c) for c in cols))


def without_source(rows: DataFrame, removed: DataFrame, key: str = "source_id") -> DataFrame:
    return rows.join(removed.select(key), key, "left_anti")


def prunable(shots: DataFrame, planned: DataFrame, used: DataFrame) -> DataFrame:
    """Shots beyond their source's plan (source_id, keep), unless starred or used."""
    beyond = shots.join(planned, "source_id").filter((F.col("shot_index") >= F.col("keep")) & ~F.col("top_pick"))
    return beyond.join(used.select("shot_id").distinct(), "shot_id", "left_anti").drop("keep")


def counts_of(**tables: DataFrame) -> DataFrame:
    """(table, n) for each."""
    return reduce(DataFrame.unionByName, [t.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()])


def duplicate_files(sources: DataFrame) -> DataFrame:
    """Later files with the same content in a library, and the file that stays: the oldest, then least id."""
    first = W.partitionBy("workspace_id", "content_hash").orderBy("created_at", "source_id")
    rows = sources.withColumn("r", F.row_number().over(first)).withColumn("kept_id", F.first("source_id").over(first))
    return rows.filter("r > 1").select("source_id", "kept_id", "workspace_id", "content_hash")


def source_status(sources: DataFrame, shots: DataFrame) -> DataFrame:
    """Status of each source from its shots, and the oldest version they were analysed with."""
    v = F.transform(F.split("analysis_version", r"\."), lambda x: x.cast("int"))
    per = shots.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "needs_review").alias("review"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"), F.min_by("analysis_version", v).alias("version"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "pending").when(F.col("review") > 0, "needs_review").when(F.col("failed") == n, "failed").when(F.col("pending") > 0, "analysing").otherwise("indexed")
    return sources.select("source_id").join(per, "source_id", "left").select("source_id", status.alias("status"), "version")


def primary_shots(shots: DataFrame) -> DataFrame:
    """The longest shot of each source; ties go to the first."""
    longest = W.partitionBy("source_id").orderBy(F.desc("duration_s"), "shot_index")
    return shots.withColumn("_r", F.row_number().over(longest)).filter("_r = 1").drop("_r")


def spread_sample(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """n rows evenly spread over the order of key: a sampling operator. Rows are numbered inside ranges, ranges by their counts."""
    step = max(1, -(-total // n))
    parts = keep(rows.select(key).repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "spread")
    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).drop("_n")
    inside = parts.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(key)) - 1)
    return inside.join(before, "_p").filter((F.col("_before") + F.col("_i")) % step == 0).select(key).limit(n)


def pilot(files: DataFrame, count: int, video_share: float = 0.6, seed: int = 42) -> DataFrame:
    """A stratified sample: about video_share videos, the rest photos, each stratum in hash order, short strata backfilled.

    Each stratum's first `count` come from a sort that keeps only so many rows a task; all that follows is as small.
    """
    order = [F.xxhash64("source_id", F.lit(seed)), "source_id"]
    first = [files.filter(F.col("media_kind") == k).orderBy(*order).limit(count) for k in ("video", "image")]
    rows = first[0].unionByName(first[1]).withColumn("r", F.row_number().over(W.partitionBy("media_kind").orderBy(*order)))
    quota = F.when(F.col("media_kind") == "video", round(count * video_share)).otherwise(count - round(count * video_share))
    return rows.orderBy((F.col("r") > quota).cast("int"), "r", "media_kind").limit(count).select("source_id", "media_kind")


def intake_verdict(most_seconds: float, most_bytes: int) -> Column:
    """too_long (videos only), too_big, or ok."""
    return F.when((F.col("media_kind") != "image") & (F.col("duration_s") > most_seconds), "too_long").when(F.col("filesize_bytes") > most_bytes, "too_big").otherwise("ok")


def human_duration(s: Column) -> Column:
    """Whole seconds, halves to the even number, as `3 h 04 min`, `3 min 04 s` or `4 s`."""
    n = F.bround(s).cast("long")
    h, m = F.floor(n / 3600), F.floor(n % 3600 / 60)
    return F.when(n >= 3600, F.format_string("%d h %02d min", h, m)).when(n >= 60, F.format_string("%d min %02d s", m, n % 60)).otherwise(F.format_string("%d s", n))


def intake(forced: Column, free_bytes: Column, most_seconds: float = 600.0, forced_seconds: float = 3600.0, most_gb: float = 5.0, headroom_gb: float = 5.0) -> tuple[Column, Column]:
    """(verdict, detail): too_long (not for images), too_big, or null if a file may go ahead.

    A forced file meets a longer limit of length, and of size only what is free but for the headroom. Unknown or zero lengths and sizes,
    and limits of 0, turn nothing away; without a known free space no forced file is too big.
    """
    gb, size, forced = 1e9, F.col("filesize_bytes"), F.coalesce(forced, F.lit(False))
    limit = F.when(forced, F.lit(forced_seconds)).otherwise(F.lit(most_seconds))
    long = ~F.coalesce(F.col("media_kind") == "image", F.lit(False)) & (F.col("duration_s") > 0) & (limit > 0) & (F.col("duration_s") > limit)
    room = F.greatest(F.lit(0.0), free_bytes / gb - headroom_gb)
    full = (size > 0) & forced & (size > free_bytes - headroom_gb * gb)
    big = (size > 0) & ~forced & F.lit(most_gb > 0) & (size > most_gb * gb)
    verdict = F.when(long, "too_long").when(full | big, "too_big")
    detail = (
        F.when(long, F.concat(human_duration(F.col("duration_s")), F.lit(" long; the limit is "), human_duration(limit), F.lit(". Probably a recording rather than B-roll.")))
        .when(full, F.format_string("%.1f GB is more than this server can hold at once (%.1f GB free to use).", size / gb, room))
        .when(big, F.format_string(f"%.1f GB; the limit is {most_gb:g} GB.", size / gb))
    )
    return verdict, detail
