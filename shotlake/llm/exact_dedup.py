"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size; the distinct blocks are sorted and numbered, and from then on a block is its
number. Adjacent numbers are paired and the distinct pairs numbered again, until each text is one number. Equal
numbers (with equal block counts) mean equal texts, for numbers are given to contents, not to hashes: a hash only
carries a number back to where its block stands, and blocks whose hashes collide make the job use a wider hash.
"""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm.common import attach, keep, number, table, text_or_empty

BLOCK_BYTES = 8192
#: Blocks that are sorted together, 32 MB at most.
NAMED_AT_ONCE = 4000


def _hash64(c):
    return F.xxhash64(c)


def _hash256(c):
    return F.sha2(c, 256)


def identities(docs: DataFrame, text: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs but the text, with _rk (the row), _sha (SHA-256 of the text), and (_nb, _name): equal exactly for equal texts.

    A null text counts as empty. Rows stay as many as they are, repeated ones too.
    """
    whole = text_or_empty(text).cast("binary")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(whole) - 1) / block).cast("int"))), lambda i: F.substr(whole, i * block + 1, F.lit(block)))
    for to_hash in (_hash64, _hash256):
        rows = keep(docs.select(*(c for c in docs.columns if c != text), F.monotonically_increasing_id().alias("_rk"), F.sha2(whole, 256).alias("_sha"), F.transform(cuts, to_hash).alias("_hs")).withColumn("_nb", F.size("_hs")), "dd-rows")
        blocks = docs.select(F.explode(cuts).alias("_b")).groupBy(to_hash("_b").alias("_h"), "_b").agg(F.count("*").alias("n"))
        most, total = rows.agg(F.max("_nb"), F.sum("_nb")).first()
        names = keep(blocks.withColumn("_name", number(blocks, ["_h", "_b"], per=NAMED_AT_ONCE, by=F.xxhash64("_h"), rows=total or 0)).select("_h", "n", "_name"), "dd-names")
        if names.groupBy("_h").count().filter("count > 1").isEmpty():
            break
    rest = [c for c in rows.columns if c != "_hs"]
    short = attach(rows.filter("_nb = 1").withColumn("_h", F.col("_hs")[0]), names, ["_h"], ["_rk"]).select(*rest, "_name")
    if (most or 1) == 1:
        return short
    long = rows.filter("_nb > 1")
    parts = keep(attach(long.select("_rk", F.posexplode("_hs").alias("_i", "_h")), names, ["_h"], ["_rk", "_i"]).select("_rk", "_i", "_name"), "dd-level")
    for _ in range(math.ceil(math.log2(most))):
        pairs = keep(parts.groupBy("_rk", F.floor(F.col("_i") / 2).alias("_i")).agg(F.max(F.when(F.col("_i") % 2 == 0, F.col("_name"))).alias("_a"), F.coalesce(F.max(F.when(F.col("_i") % 2 == 1, F.col("_name"))), F.lit(-1)).alias("_z")), "dd-pairs")
        known = keep(pairs.groupBy("_a", "_z").agg(F.count("*").alias("n")), "dd-distinct")
        known = keep(known.withColumn("_name", number(known, ["_a", "_z"])), "dd-names")
        parts = keep(attach(pairs, known, ["_a", "_z"], ["_rk", "_i"]).select("_rk", "_i", "_name"), "dd-level")
    return short.unionByName(long.join(parts.select("_rk", "_name"), "_rk").select(*rest, "_name"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays (a null id is smaller than any; of wholly repeated rows, one
    stays). Null texts equal empty ones. An empty table gives an empty result; other columns play no part.
    """
    ids = keep(identities(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", block), "dd-ids")
    groups = keep(ids.groupBy("_nb", "_name").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "_rk")).alias("_keep")).withColumn("group_size", F.col("n")), "dd-groups")
    out = attach(ids, groups, ["_nb", "_name"], ["_rk"])
    return out.select("doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_keep._rk") == F.col("_rk")).alias("kept"), F.col("_sha").alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
QUERIES = {"op8_exact_dedup": op8_exact_dedup}
