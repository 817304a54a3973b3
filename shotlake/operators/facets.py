"""Facet counts, folder roll-ups, tag audits, and the ledger of model calls."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def facet_counts(shots: DataFrame, scalars: list[str], lists: list[str], by: str | None = None) -> DataFrame:
    """(facet, value, by, n) in one pass: every scalar and list entry, with a null `by` row for all."""
    one = [F.array(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))) for c in scalars]
    many = [_entries(c) for c in lists]
    rows = shots.select(*([by] if by else []), F.explode(F.concat(*one, *many)).alias("x")).select(*([by] if by else []), "x.*").filter("value is not null")
    if by is None:
        return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))
    return rows.groupingSets([["facet", "value", by], ["facet", "value"]], "facet", "value", by).agg(F.count("*").alias("n"))


def _entries(column: str) -> Column:
    return F.transform(column, lambda v: F.struct(F.lit(column).alias("facet"), v.alias("value")))


def pair_counts(shots: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): shots in which entries of two list facets stand together."""
    return shots.select(F.explode(a).alias("a"), F.col(b).alias("_b")).select("a", F.explode("_b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def ancestors(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def folder_rollup(rows: DataFrame, folders: DataFrame, key: str, path: str, at: str, newest: int) -> DataFrame:
    """Of each folder: distinct rows in or below it, the newest of them, and whether it has folders below. Empty folders count 0."""
    inside = rows.select(key, at, F.explode(ancestors(F.col(path))).alias("folder")).dropDuplicates(["folder", key])
    order = W.partitionBy("folder").orderBy(F.desc(at), key)
    top = inside.withColumn("r", F.row_number().over(order)).groupBy("folder").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= newest, F.struct("r", key)))).alias("x"))
    parents = folders.select(F.regexp_extract("folder", "^(.*)/", 1).alias("folder")).filter("folder <> ''").distinct().withColumn("has_children", F.lit(True))
    return folders.join(top, "folder", "left").join(parents, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("x", lambda s: s[key]), ","), F.lit("")).alias("newest"), F.coalesce("has_children", F.lit(False)).alias("has_children"))


def folder_counts(clips: DataFrame, category: str = "category", secondary: str = "secondary") -> DataFrame:
    """(folder, direct, also): clips filed in a folder itself, and clips filed neither there nor below that have it as a secondary folder. Null folders count nowhere."""
    direct = clips.filter(F.col(category).isNotNull()).groupBy(F.col(category).alias("folder")).agg(F.count("*").alias("direct"))
    other = clips.select(F.col(category).alias("_c"), F.explode(F.array_distinct(secondary)).alias("folder")).filter(F.col("folder").isNotNull())
    away = F.col("_c").isNull() | ((F.col("_c") != F.col("folder")) & ~F.startswith(F.col("_c"), F.concat(F.col("folder"), F.lit("/"))))
    also = other.filter(away).groupBy("folder").agg(F.count("*").alias("also"))
    return direct.join(also, "folder", "full_outer").select("folder", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("also", F.lit(0)).alias("also"))


def quick_counts() -> list[Column]:
    """Aggregates of shots (top_pick, featured, category, status): total, top_picks, featured, unsorted, review."""
    return [F.count("*").alias("total"), F.count_if("top_pick").alias("top_picks"), F.count_if("featured").alias("featured"), F.count_if(F.col("category").isNull()).alias("unsorted"), F.count_if(F.col("status") == "needs_review").alias("review")]


def recent_jobs(jobs: DataFrame, limit: int = 40) -> DataFrame:
    """jobs (workspace_id, job_id, status, created_at, ...) with their place in a library's panel: running ones, then queued ones, then the rest, each newest first; cancelled ones don't show."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).otherwise(2)
    order = W.partitionBy("workspace_id").orderBy(rank, F.desc("created_at"), "job_id")
    return jobs.filter("status <> 'cancelled'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def jobs_by_side(jobs: DataFrame, side: Column) -> DataFrame:
    """(workspace_id, side, queued, running, done, failed): the queue counted for each kind of file."""
    states = ("queued", "running", "done", "failed")
    return jobs.filter(F.col("status").isin(*states)).groupBy("workspace_id", side.alias("side")).agg(*(F.count_if(F.col("status") == s).alias(s) for s in states))


def waits(jobs: DataFrame, again: Column) -> DataFrame:
    """jobs (workspace_id, status, last_error) -> (workspace_id, waiting, daily): queued jobs whose error is worth another try (`again`), and whether one of them names a day's limit."""
    waiting = again & (F.col("status") == "queued") & (F.coalesce("last_error", F.lit("")) != "")
    said = F.regexp_replace(F.lower("last_error"), " ", "")
    return jobs.groupBy("workspace_id").agg(F.count_if(waiting).alias("waiting"), F.coalesce(F.bool_or(waiting & (F.contains(said, F.lit("perday")) | F.contains(said, F.lit("dailylimit")))), F.lit(False)).alias("daily"))


#: Words for who is in a shot, which may be common.
PEOPLE = ("man", "men", "woman", "women", "person", "people", "group", "child", "children", "boy", "girl", "baby", "crowd")


def tag_audit(tags: DataFrame, total: int, share: float = 0.12, least: int = 25) -> DataFrame:
    """tags (shot_id, tag) of a library of `total` shots: per tag its shots, share, and whether it is single or too common. Only libraries of `least` shots are judged, and words for people never are."""
    per = tags.dropDuplicates(["shot_id", "tag"]).groupBy("tag").agg(F.count("*").alias("n"))
    part = F.col("n") / F.lit(total)
    return per.select("tag", "n", F.round(part, 6).alias("share"), (F.lit(total >= least) & (part > share) & ~F.col("tag").isin(*PEOPLE)).alias("too_common"), (F.col("n") == 1).alias("single"))


def audit_report(shots: DataFrame, top: int) -> DataFrame:
    """(part, value, n) of shots (shot_id, tags, status): the `top` commonest tags, shots, tags a shot (to one place), distinct tags, tags used once, shots to be reviewed."""
    per = shots.select("shot_id", F.explode("tags").alias("tag")).distinct().groupBy("tag").agg(F.count("*").cast("double").alias("n"))
    most = per.orderBy(F.desc("n"), "tag").limit(top).select(F.lit("most").alias("part"), F.col("tag").alias("value"), "n")
    rows = shots.agg(F.count("*").cast("double").alias("shots"), F.round(F.sum(F.size(F.coalesce("tags", F.array().cast("array<string>")))) / F.count("*"), 1).alias("tags_per_shot"), F.count_if(F.col("status") == "needs_review").cast("double").alias("needs_review"))
    tags = per.agg(F.count("*").cast("double").alias("distinct_tags"), F.count_if(F.col("n") == 1).cast("double").alias("tags_used_once"))
    figures = [d.select(F.lit(c).alias("part"), F.lit("").alias("value"), F.col(c).alias("n")) for d in (rows, tags) for c in d.columns]
    for f in figures:
        most = most.unionByName(f)
    return most


def histogram(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bucket, n) of half-open buckets [edge, next edge), empty ones too."""
    spark = rows.sparkSession
    labels = spark.createDataFrame([(i, f"{a:g}-{b:g}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "i int, bucket string")
    bucket = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        bucket = F.when((F.col(column) >= a) & (F.col(column) < b), i).otherwise(bucket)
    return labels.join(rows.select(bucket.alias("i")).groupBy("i").agg(F.count("*").alias("n")), "i", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def ledger_totals(calls: DataFrame) -> DataFrame:
    """Calls, tokens, cost and failures by kind and day, by kind, and over all, in one rollup."""
    return calls.rollup("kind", F.to_date("at").alias("day")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 2).alias("usd"), F.count_if(~F.col("ok")).alias("failed"))


def trailing_spend(calls: DataFrame, by: str, seconds: int = 86_400) -> DataFrame:
    """Each call with what its library spent in the trailing window, both ends included.

    A library's calls are cut into stretches as long as the window. A call sees its own stretch up to itself, and the one before it from
    as far in on: two running sums, so that the work grows with the calls, whatever a window holds, and nothing is taken off a sum.
    """
    t, length = F.unix_micros(F.col("at").cast("timestamp")), seconds * 1_000_000
    mine = F.floor(t / length)
    rows = calls.withColumn("_u", F.pmod(t, F.lit(length))).withColumn("_k", F.explode(F.array(mine, mine + 1))).withColumn("_own", F.col("_k") == mine)
    # a frame that runs to the end would be added up anew for each row, so the stretch before runs backwards
    upto = lambda order, mask: F.sum(F.when(mask, F.col("cost_usd"))).over(W.partitionBy(by, "_k").orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_now", upto(F.col("_u"), F.col("_own"))).withColumn("_then", upto(F.desc("_u"), ~F.col("_own"))).filter("_own")
    return rows.withColumn("spent", F.round(F.coalesce(F.col("_now") + F.col("_then"), "_now", "_then"), 4)).drop("_u", "_k", "_own", "_now", "_then")


def price(kind: Column, tokens: Column, cached: Column, rates: dict[str, tuple[float, float]]) -> Column:
    """Cost of a call: fresh tokens at the kind's rate per million, cached ones at a tenth of it, plus the rate per call."""
    out = F.lit(0.0)
    for name, (per_million, per_call) in rates.items():
        fresh = F.greatest(tokens - cached, F.lit(0))
        out = F.when(kind == name, (fresh + F.least(cached, tokens) * 0.1) * per_million / 1e6 + per_call).otherwise(out)
    return out


def merge_proposals(proposals: DataFrame, least: int, tree: DataFrame | None = None) -> DataFrame:
    """proposals (parent, name, source_id): names of a parent that are one folder but for spelling are one, named as a folder of the tree (parent, name) or the biggest.

    Greedy from the biggest down, then by name, so a parent's names are folded together; there is one row per name, not per clip.
    """
    import pandas as pd

    from shotlake.operators.folders import same_folder

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, str]] = []
        real = g.loc[g["n"] < 0, "name"].sort_values().tolist()
        out = []
        for r in g[g["n"] >= 0].sort_values(["n", "name"], ascending=[False, True]).itertuples():
            name = next((to for first, to in kept if same_folder(first, r.name)), None)
            if name is None:
                name = next((x for x in real if same_folder(x, r.name)), r.name)
                kept.append((name, name))
            out.append((r.parent, r.name, name, name in real))
        return pd.DataFrame(out, columns=["parent", "name", "merged", "existing"])

    sizes = proposals.groupBy("parent", "name").agg(F.count_distinct("source_id").alias("n"))
    if tree is not None:
        sizes = sizes.unionByName(tree.select("parent", "name", F.lit(-1).cast("long").alias("n")))
    names = sizes.groupBy("parent").applyInPandas(fold, "parent string, name string, merged string, existing boolean")
    per = proposals.join(names, ["parent", "name"]).groupBy("parent", F.col("merged").alias("name")).agg(F.count_distinct("source_id").alias("files"), F.max("existing").alias("existing"))
    return per.select("parent", "name", "files", (F.col("files") >= least).alias("enough"), "existing")
