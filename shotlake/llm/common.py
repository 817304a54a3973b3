"""Helpers that the text operators share: written stages, and joins that no hot key can bend."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.sources.stages import keep, shared_dir

__all__ = ["attach", "components", "crc_of_id", "fresh", "keep", "number", "shared_dir", "sums_before", "table", "text_or_empty"]

#: A key counts as hot beyond this share of the rows; so fewer keys than 1 / HOT_SHARE are hot, whatever the size.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(df: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], count: str = "n", tell: str | None = None) -> DataFrame:
    """Left join one row per key onto df without sending a hot key to one task.

    groups: a written table with one row per key (keys are never null); its column `count` says how many rows of df have
    that key. Keys above HOT_SHARE of all rows, fewer than 1 / HOT_SHARE, are broadcast; their rows are dealt by a
    salt over `spread` and pass the join of the others by. `tell`: name of a column that says if a key was found.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    values = [c for c in groups.columns if c not in keys and c != count]
    at_least = total * HOT_SHARE
    packed = groups.select(*keys, count, F.struct(F.lit(1).alias("_one"), *values).alias("_v"))
    hot = packed.filter(F.col(count) > at_least).select(*keys, F.col("_v").alias("_hot"))
    cold = packed.filter(F.col(count) <= at_least).select(*keys, F.lit(0).alias("_salt"), F.col("_v").alias("_cold"))
    out = df.join(F.broadcast(hot), keys, "left")
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(997)).cast("int")).otherwise(0)
    out = out.withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    found = [F.col("_v").isNotNull().alias(tell)] if tell else []
    return out.select(*df.columns, *(F.col("_v")[v].alias(v) for v in values), *found)


def number(df: DataFrame, order: list[str], per: int = 100_000, by: Column | None = None, rows: int | None = None) -> Column:
    """A distinct long for each row of df, from sorting its rows inside hash buckets of about `per` rows."""
    from pyspark.sql import Window

    buckets = max(1, -(-(df.count() if rows is None else rows) // per))
    bucket = F.pmod(F.xxhash64(*order) if by is None else by, F.lit(buckets))
    return F.shiftleft(bucket, 40) + F.row_number().over(Window.partitionBy(bucket).orderBy(*order))


def sums_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """df (one row per keys and order, a long from 0) with `name`: the sum of value over smaller orders. Two levels, so a key's rows spread over tasks."""
    from pyspark.sql import Window

    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    tops = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    tops = tops.select(*keys, "_block", (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_sum")).alias("_top"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(order)) - F.col(value)
    return rows.withColumn("_inside", inside).hint("merge").join(tops.hint("merge"), [*keys, "_block"]).withColumn(name, F.col("_top") + F.col("_inside")).select(*df.columns, name)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until none is taken (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """CRC-32 of a document's id written as text (null: of nothing)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a written table of edges (u, v, both long): rows (node, root).

    Each round hooks every node to its smallest neighbour and contracts; give node ids in random order (hashes), so
    that rounds grow with the logarithm of the size. Every step is a join through attach(), so hubs stay split.
    """
    found = None
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = keep(both.groupBy("u").agg(F.count("*").alias("n"), F.least("u", F.min("v")).alias("p")), "hook")
        if found is None:
            found = keep(hook.select(F.col("u").alias("node"), F.col("p").alias("root")), "roots")
        else:
            used = keep(found.groupBy(F.col("root").alias("u")).agg(F.count("*").alias("n")).join(hook.select("u", "p"), "u"), "moves")
            found = keep(attach(found.withColumnRenamed("root", "u"), used, ["u"], ["node"]).select("node", F.coalesce("p", "u").alias("root")), "roots")
        left = attach(edges.select("u", "v"), hook, ["u"], ["v"]).select("v", F.col("p").alias("a"))
        right = attach(left.withColumnRenamed("v", "u"), hook, ["u"], ["a"]).select("a", F.col("p").alias("b"))
        edges = keep(right.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found
