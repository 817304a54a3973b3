"""Matching written folders to real ones, placing clips in a client's tree, and applying decisions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.sources.stages import keep


def squashed(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), "[^a-z0-9]", "")


def match(written: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """written (key, written) -> path: the same path, else the same but for spelling, else the only leaf whose last part it is."""
    last = leaves.select(squashed(F.element_at(F.split("path", "/"), -1)).alias("_k"), F.col("path").alias("c"))
    last = last.groupBy("_k").agg(F.min("c").alias("c"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    spelt = leaves.select(squashed(F.col("path")).alias("_k"), F.col("path").alias("b")).groupBy("_k").agg(F.min("b").alias("b"))
    out = written.join(leaves.select(F.col("path").alias("a")), F.col("written") == F.col("a"), "left").withColumn("_k", squashed(F.col("written")))
    return out.join(spelt, "_k", "left").join(last, "_k", "left").select(key, F.coalesce("a", "b", "c").alias("path"))


#: Names shorter than this are in no other name.
LEAST_PART = 4


def same_folder(a: str, b: str) -> bool:
    """One folder but for spelling: equal letters and digits, a plural, or one inside the other."""
    a, b = ("".join(c for c in x.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789") for x in (a, b))
    return bool(a and b) and (a == b or a.rstrip("s") == b.rstrip("s") or (min(len(a), len(b)) >= LEAST_PART and (a in b or b in a)))


def near(names: DataFrame) -> DataFrame:
    """names (parent, name): pairs under one parent that are one folder but for spelling, see same_folder().

    A name meets those it equals without its plural, and those whose letters are a stretch of its own: keys are equal
    in both joins, so no pair is tried in vain.
    """
    s = squashed(F.col("name"))
    keyed = names.select("parent", "name", s.alias("_s")).filter("_s <> ''").distinct()
    plural = keyed.withColumn("_k", F.rtrim("_s", F.lit("s")))
    pairs = plural.join(plural.select("parent", "_k", F.col("name").alias("near")), ["parent", "_k"]).select("parent", "name", "near")
    n = F.length("_s")
    starts = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(LEAST_PART), F.greatest(F.lit(LEAST_PART), n - i + 1)), lambda k: F.substr(F.col("_s"), i, k))), lambda x: F.length(x[0]) >= LEAST_PART)
    parts = keyed.filter(n >= LEAST_PART).select("parent", F.col("name").alias("long"), F.explode(F.array_distinct(F.flatten(starts))).alias("_s"))
    inside = keyed.filter(n >= LEAST_PART).join(parts, ["parent", "_s"]).select("parent", F.least("name", "long").alias("name"), F.greatest("name", "long").alias("near"))
    return pairs.unionByName(inside).filter("name < near").distinct()


def resolve(proposed: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """proposed (key, proposal) -> existing (a sibling that is the same folder) or created (a new path); neither if its parent is unknown.

    nodes (path) are the folders there are. The parent is matched as match() does; the name is cleaned: words with a capital, 40 letters.
    """
    path = F.btrim(F.col("proposal"), F.lit("/ "))
    raw = F.element_at(F.split(path, "/"), -1)
    name = F.btrim(F.substring(F.array_join(F.transform(F.split(F.regexp_replace(F.trim(raw), r"[\s_]+", " "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))), " "), 1, 40))
    rows = proposed.select(key, F.regexp_extract(path, "^(.*)/", 1).alias("written"), name.alias("name"))
    rows = rows.join(match(rows.select(key, "written").filter("written <> ''"), nodes, key), key).filter("path IS NOT NULL AND name <> ''").withColumnRenamed("path", "parent")
    children = nodes.select(F.regexp_extract("path", "^(.*)/", 1).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name")).filter("parent <> ''")
    both = near(rows.select("parent", "name").unionByName(children).distinct())
    either = both.unionByName(both.select("parent", F.col("near").alias("name"), F.col("name").alias("near")))
    same = children.select("parent", "name", F.col("name").alias("near")).unionByName(either)
    sibling = rows.join(same, ["parent", "name"]).join(children.select("parent", F.col("name").alias("near")), ["parent", "near"], "left_semi").groupBy(key).agg(F.min("near").alias("sibling"))
    found = rows.join(sibling, key, "left")
    at = lambda c: F.concat_ws("/", "parent", c)
    return proposed.select(key).join(found.select(key, F.when(F.col("sibling").isNotNull(), at("sibling")).alias("existing"), F.when(F.col("sibling").isNull(), at("name")).alias("created")), key, "left")


def distinct_any_case(v: Column) -> Column:
    """The list without entries that were there before in any case."""
    return F.filter(v, lambda x, i: F.array_position(F.transform(v, F.lower), F.lower(x)) == i + 1)


def client_tree(shots: DataFrame, leaves: DataFrame, review: str = "To review", unsorted: str = "Unsorted", picks: str | None = "Top picks", route: bool = True) -> DataFrame:
    """shots (source_id, shot_id, shot_index, duration_s, category, secondary, doubt, top_pick, prefix) -> (source_id, folder, why, shot_id) under a client's own tree.

    A file's home is its longest shot's folder, if that is a leaf; the review folder, if that shot is in doubt (and `route`); else the
    unsorted one. Shots not in doubt also lie in their folder and secondary ones that are leaves, but for the file's home; starred shots in
    the picks. All of it hangs under the prefix, which may be null. Nulls are no folders, no doubt, no star.
    """
    # written: three sides read the shots, which may be costly to make
    shots = keep(shots.select("source_id", "shot_id", "shot_index", "duration_s", "category", "secondary", "doubt", "top_pick", "prefix"), "tree-shots")
    w = W.partitionBy("source_id").orderBy(F.desc("duration_s"), "shot_index")
    known = leaves.select(F.col("path").alias("folder")).distinct()
    doubt = F.coalesce("doubt", F.lit(False)) & F.lit(route)
    under = lambda folder: F.concat_ws("/", "prefix", folder)
    firsts = shots.withColumn("_r", F.row_number().over(w)).filter("_r = 1").withColumn("_d", doubt).join(known.withColumnRenamed("folder", "category").withColumn("_leaf", F.lit(True)), "category", "left")
    real = F.when(~F.col("_d") & F.col("_leaf"), F.col("category"))
    homes = keep(firsts.select("source_id", "prefix", real.alias("home"), F.when(F.col("_d"), review).otherwise(F.coalesce(real, F.lit(unsorted))).alias("folder")), "tree-homes")
    places = shots.filter(~doubt).select("source_id", "shot_id", "prefix", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("category"), F.coalesce("secondary", F.array().cast("array<string>")))))).alias("folder"))
    also = places.join(known, "folder", "left_semi").join(homes.select("source_id", "home"), "source_id").filter(F.col("home").isNull() | (F.col("folder") != F.col("home")))
    rows = homes.select("source_id", under("folder").alias("folder"), F.lit("home").alias("why"), F.lit(None).cast(shots.schema["shot_id"].dataType).alias("shot_id"))
    rows = rows.unionByName(also.select("source_id", under("folder").alias("folder"), F.lit("also").alias("why"), "shot_id").distinct())
    starred = shots.filter("top_pick").select("source_id", under(F.lit(picks)).alias("folder"), F.lit("pick").alias("why"), "shot_id").distinct()
    return rows.unionByName(starred) if picks else rows


def approve(clips: DataFrame, proposed: DataFrame) -> DataFrame:
    """clips (source_id, category, status, corrected) after approved proposals (source_id, to): uncorrected ones move and need no review."""
    j = clips.join(proposed, "source_id", "left").withColumn("_go", F.col("to").isNotNull() & ~F.col("corrected"))
    return j.select("source_id", F.when(F.col("_go"), F.col("to")).otherwise(F.col("category")).alias("category"), F.when(F.col("_go") & (F.col("status") == "needs_review"), "indexed").otherwise(F.col("status")).alias("status"))


def rerank(short: DataFrame, choice: DataFrame) -> DataFrame:
    """short (job_id, rank, call_id) in the order of choice (job_id, pos, rank): named ranks first, each once; the others after, as they were."""
    first = choice.groupBy("job_id", "rank").agg(F.min("pos").alias("pos"))
    order = W.partitionBy("job_id").orderBy(F.col("pos").isNull(), "pos", "rank")
    return short.join(first, ["job_id", "rank"], "left").select("job_id", F.row_number().over(order).alias("place"), "call_id")
