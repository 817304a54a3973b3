"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words. A source's documents, in shuffled order, lie end to end on a tape that is cut into equal blocks of
tokens (the last one is what is left). A schedule of 2^m slots takes the van der Corput points t -> bit-reversed t / 2^m through the cumulative
weights to a source; slots are ranked per source, and the k-th slot of a source takes block k of its tape, starting
over after the last. Because 2^m points of that sequence are evenly spaced, each source gets its share of slots within
one slot, and any stretch of the schedule is close to the weights as well.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.llm.common import HOT_SHARE, keep, sums_before, table, text_or_empty

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
MOST_REPEATS = 3
#: Slots are ranked, and documents laid out, in chunks of about so many.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """sizes (source, size) -> also sidx, weight, target: shares of all words by weight, none above `most` times its size.

    Weights go to sources by code point, null last, repeating. Giving the excess on to the others until none is above
    its limit ends where one level times the weight, cut at the limit, adds up to all words: sources fill up in order
    of limit / weight. There is one row per source, so one task orders them.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sizes.withColumn("sidx", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("sidx") - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("size") * F.lit(float(most)))
    fill = W.orderBy(F.col("most") / F.col("weight"), "sidx")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", F.when(F.col("most") > level * F.col("weight"), level))
    # the first source that does not fill up sets the level for itself and all after it
    rows = rows.withColumn("_level", F.first("_level", ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return rows.withColumn("target", F.coalesce(F.least("most", F.col("_level") * F.col("weight")), F.col("most"))).drop("_level", "most")


def _bit_reversed(t: Column, bits: int) -> Column:
    """The lowest `bits` bits of t in reverse."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask)
        t = F.shiftrightunsigned(t, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(t.bitwiseAND(m), shift))
    return F.shiftrightunsigned(t, 64 - bits) if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame, block: int = BLOCK_WORDS, most: int = MOST_REPEATS) -> DataFrame:
    """sources (sidx, size, target) -> one row per slot: slot, sidx, rank (from 0 in its source), round, block.

    Source s holds the stretch [from, to) of the 2^m points j in the order of the cumulative weights; j's slot is its
    bit-reversal. Points beyond all sources are idle. A source never starts over more than `most` times.
    """
    need = sources.filter("size > 0").withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("need", F.col("target") * F.col("blocks") / F.col("size"))
    total = need.agg(F.sum("need")).first()[0] or 0.0
    bits = max(0, math.ceil(math.log2(max(1.0, total + 1))))
    upto = F.sum("need").over(W.orderBy("sidx").rowsBetween(W.unboundedPreceding, 0))
    spans = need.withColumn("to", F.ceil(F.round(upto, 6))).withColumn("from", F.coalesce(F.lag("to").over(W.orderBy("sidx")), F.lit(0).cast("long"))).filter("to > from")
    chunks = spans.select("sidx", "blocks", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / CHUNK), F.floor((F.col("to") - 1) / CHUNK))).alias("c")).repartition("sidx", "c")
    slots = chunks.select("sidx", "blocks", F.explode(F.sequence(F.greatest("from", F.col("c") * CHUNK), F.least(F.col("to"), (F.col("c") + 1) * CHUNK) - 1)).alias("point"))
    # Spark takes what a few rows explode to for a few rows: the hints keep it from broadcasting them
    # as many chunks of the schedule as there are chunks of points
    part = max(0, bits - int(math.log2(CHUNK)))
    slots = slots.select("sidx", "blocks", _bit_reversed(F.col("point").cast("long"), bits).alias("slot")).withColumn("part", F.shiftrightunsigned("slot", bits - part))
    ahead = sums_before(slots.groupBy("sidx", "part").agg(F.count("*").alias("k")), ["sidx"], "part", "k", "ahead").drop("k")
    ranked = slots.withColumn("_r", F.row_number().over(W.partitionBy("sidx", "part").orderBy("slot")) - 1).hint("merge").join(ahead.hint("merge"), ["sidx", "part"]).withColumn("rank", F.col("_r") + F.col("ahead"))
    return ranked.withColumn("round", F.floor(F.col("rank") / F.col("blocks"))).filter(F.col("round") < most).select("slot", "sidx", "rank", "round", (F.col("rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, block: int = BLOCK_WORDS, most: int = MOST_REPEATS, seed: int = 0, carry: tuple = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source, shares (taken / size), and the columns `carry`.

    A null or empty text has size 0 and nothing is taken of it; a null source is a source, the last; repeated rows are
    rows of their own; an empty table gives an empty result. Reruns agree: the shuffle is a hash of (seed, doc_id, text).
    Only if over 0.1% of all rows are equal in both, so that one chunk can't hold them, are these dealt by place in the input.
    """
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id), text_or_empty(text))
    sized = keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed.alias("_h"), F.monotonically_increasing_id().alias("_rk"), *carry), "mix-sizes")
    same = sized.groupBy("_h").agg(F.count("*").alias("_many"))
    hot = same.filter(F.col("_many") > F.greatest(F.lit(CHUNK), F.lit(int(sized.count() * HOT_SHARE)))).select("_h", F.lit(True).alias("_hot"))
    sized = sized.join(F.broadcast(hot), "_h", "left").withColumn("_h", F.when(F.col("_hot"), F.xxhash64("_h", "_rk")).otherwise(F.col("_h"))).drop("_hot", "_rk")
    sources = keep(targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), weights, most), "mix-sources")
    # one row per source: Spark broadcasts it while it is small
    rows = sized.join(sources.select(F.col("source").alias("_s"), "sidx", F.col("size").alias("source_size"), "target", F.ceil(F.col("rows") / CHUNK).alias("_k")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_p", F.floor(F.pmod("_h", F.lit(1 << 40)).cast("double") / (1 << 40) * F.col("_k")))
    before = rows.groupBy("sidx", "_p").agg(F.sum("size").alias("_w"))
    before = sums_before(before, ["sidx"], "_p", "_w", "_base").drop("_w")
    order = W.partitionBy("sidx", "_p").orderBy("_h", "doc_id", "size", *carry)
    laid = rows.withColumn("_n", F.row_number().over(order)).withColumn("_in", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    laid = keep(laid.hint("merge").join(before.hint("merge"), ["sidx", "_p"]).withColumn("_at", F.col("_base") + F.col("_in")).select("doc_id", "source", "size", "sidx", "source_size", "target", "_p", "_n", "_at", *carry), "mix-tape")
    # no product of positions is taken: a source may hold any number of words
    holding = lambda x: F.expr(f"({x}) div {block}")
    pieces = laid.filter("size > 0").select("sidx", "_p", "_n", "size", "_at", "source_size", F.explode(F.sequence(holding("_at"), holding("_at + size - 1"))).alias("block"))
    pieces = pieces.withColumn("_words", F.least((F.col("block") + 1) * block, F.col("_at") + F.col("size")) - F.greatest(F.col("block") * block, F.col("_at")))
    turns = schedule(sources.select("sidx", "size", "target"), block, most).groupBy("sidx", "block").agg(F.count("*").alias("_turns"))
    taken = pieces.hint("merge").join(turns.hint("merge"), ["sidx", "block"]).groupBy("sidx", "_p", "_n").agg(F.sum(F.col("_words") * F.col("_turns")).alias("taken"))
    out = laid.join(taken, ["sidx", "_p", "_n"], "left")
    took = F.coalesce("taken", F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", took.alias("taken"), "source", F.when(F.col("size") > 0, took / F.col("size")).otherwise(0.0).alias("shares"), *carry)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op1_mixing": op1_mixing}
