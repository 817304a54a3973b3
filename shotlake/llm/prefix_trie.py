"""A prefix trie of conversations by Spark SQL's ROLLUP over positional columns of turn ids.

Distinct turns are numbered, and the first turns of a conversation stand in the columns t1, t2, ... of one row. A ROLLUP over
them forms the groups of all prefixes at once, and grouping_id says how deep a group is. Conversations that are longer
and still share their node go on in a further block of columns, keyed by that node.

A conversation owns a node if it is the smallest member; then it owns all nodes below on its way. So the nodes are the
turns of each conversation from its first owned depth on, and what a node that is nobody else's says needs no group.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.llm.common import attach, keep, number, table

#: Columns of the first block and of the further ones.
FIRST, NEXT = 8, 32
#: Ids in one piece of the list that a digest is taken of.
PIECE = 8192
WORD = r"[^\x20\x09-\x0D]+"


def placed(turns: DataFrame) -> DataFrame:
    """(c, pos from 1, key, w): the turns in order, without a window over a whole conversation, which may hold a third of all rows.

    Rows are ranged over tasks by conversation and order, numbered inside each, and lifted by what the tasks before hold.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn"), role.alias("role"), F.sha2(text, 256).alias("tie"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    order = [F.col("turn").asc_nulls_first(), "role", "tie"]
    rows = keep(rows.repartitionByRange("c", *order).withColumn("pid", F.spark_partition_id()), "trie-rows")
    parts = rows.groupBy("c", "pid").agg(F.count("*").alias("n"))
    before = parts.select("c", "pid", (F.sum("n").over(W.partitionBy("c").orderBy("pid")) - F.col("n")).alias("before"))
    inside = rows.withColumn("rn", F.row_number().over(W.partitionBy("c", "pid").orderBy(*order)))
    return inside.join(before.filter("before > 0"), ["c", "pid"], "left").select("c", (F.col("rn") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "w")


def named(rows: DataFrame) -> DataFrame:
    """(c, pos, t, w): turns as numbers, equal exactly for equal turns (of one SHA-256)."""
    turns = keep(rows.groupBy("key").agg(F.count("*").alias("n")), "trie-turns")
    turns = keep(turns.withColumn("t", number(turns, ["key"])), "trie-names")
    return attach(rows, turns, ["key"], ["c", "pos"]).select("c", "pos", "t", "w")


def rebuilt(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, pos, t, w): the first h turns of conversation c - c % 20, then c's own turns after its first h; h = crc32(c) % 4."""

    def h(c: str) -> Column:
        return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4))

    base = convs.select("c", "n", h("c").alias("h"), (F.col("c") - F.col("c") % 20).alias("b")).filter("h > 0")
    lengths = convs.select(F.col("c").alias("b"), F.col("n").alias("bn"))
    short = base.join(lengths, "b", "left").withColumn("shift", F.col("h") - F.least("h", F.coalesce("bn", F.lit(0)))).filter("shift > 0")
    own = attach(rows.filter(F.col("pos") > h("c")), keep(short.select("c", "n", "shift"), "trie-short"), ["c"], ["pos"])
    own = own.select("c", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "t", "w")
    heads = rows.filter("pos <= 3").withColumnRenamed("c", "b")
    return own.unionByName(base.select("c", "h", "b").join(heads, "b").filter("pos <= h").select("c", "pos", "t", "w"))


class Block:
    """One block of columns: rows (c, prior, p0, t1.., w1..) and the nodes that ROLLUP finds in them."""

    def __init__(self, live: DataFrame, long: DataFrame, start: int, width: int):
        self.start, self.width = start, width
        self.ts, self.ws = [f"t{i}" for i in range(1, width + 1)], [f"w{i}" for i in range(1, width + 1)]
        here = long.filter((F.col("pos") > start) & (F.col("pos") <= start + width))
        at = [F.max(F.when(F.col("pos") == start + i, F.col(v))).alias(f"{v}{i}") for v in "tw" for i in range(1, width + 1)]
        self.rows = keep(live.join(here.groupBy("c").agg(*at), "c", "inner" if start else "left"), "trie-block")
        self.nodes = keep(self.rollup(self.rows, F.count("*").alias("n"), F.min("c").alias("m")), "trie-nodes")

    def rollup(self, rows: DataFrame, *what: Column) -> DataFrame:
        """(prior, d, path, what): all prefixes of the block that a conversation has, d turns beyond the block's start; d = 0 in the first block alone."""
        rolled = rows.rollup("prior", *self.ts).agg(F.grouping_id().alias("gid"), *what)
        d = (self.width - F.log2(F.col("gid") + 1)).cast("int")
        rolled = rolled.filter(F.col("gid") < (1 << self.width + 1) - 1).withColumn("d", d).withColumn("path", F.slice(F.array(*self.ts), F.lit(1), F.col("d")))
        reached = F.when(F.col("d") == 0, F.lit(self.start == 0)).otherwise(F.element_at("path", F.greatest("d", F.lit(1))).isNotNull())
        return rolled.filter(reached).drop("gid", *self.ts)

    def firsts(self) -> DataFrame:
        """(c, f, up): depth of the first node that c owns, if it is in this block, and the owner of the node above."""
        new = self.nodes.filter("d > 0 AND m <> prior").groupBy(F.col("m").alias("c")).agg(F.min("d").alias("d"), F.min_by("prior", "d").alias("prior"), F.min_by("path", "d").alias("path"))
        new = keep(new.select("c", "d", "prior", F.slice("path", F.lit(1), F.col("d") - 1).alias("path")), "trie-firsts")
        kids = new.filter("d > 1").groupBy("prior", "path").agg(F.count("*").alias("n"))
        above = keep(kids.join(self.nodes.select("prior", "path", F.col("m").alias("up")), ["prior", "path"]), "trie-above")
        found = attach(new, above, ["prior", "path"], ["c"])
        return found.select("c", (F.col("d") + self.start).cast("long").alias("f"), F.when(F.col("d") == 1, F.col("prior")).otherwise(F.col("up")).alias("up"))

    def going_on(self) -> DataFrame:
        """(c, prior, p0) of the conversations whose node at the block's end is shared."""
        shared = keep(self.nodes.filter((F.col("d") == self.width) & (F.col("n") > 1)).select("prior", "path", "n", F.col("m").alias("next")), "trie-shared")
        full = self.rows.filter(F.col(self.ts[-1]).isNotNull()).withColumn("path", F.array(*self.ts)).withColumn("p0", F.col("p0") + sum(F.col(w) for w in self.ws))
        return attach(full, shared, ["prior", "path"], ["c"]).filter("next IS NOT NULL").select("c", F.col("next").alias("prior"), "p0")

    def ends(self, copies: DataFrame) -> DataFrame:
        """(m, depth, c) of the conversations of `copies` (c, len) that end in this block: the node they end in."""
        here = copies.filter((F.col("len") > self.start) & (F.col("len") <= self.start + self.width))
        here = self.rows.select("c", "prior", *self.ts).join(here, "c").select("c", "prior", F.slice(F.array(*self.ts), F.lit(1), (F.col("len") - self.start).cast("int")).alias("path"), F.col("len").alias("depth"))
        shared = keep(self.nodes.filter("d > 0 AND n > 1").select("prior", "path", "n", "m"), "trie-ends")
        return attach(here, shared, ["prior", "path"], ["c"]).select("m", "depth", "c")

    def sums(self, info: DataFrame) -> DataFrame:
        """(c, pos, n_convs, n_leaves, saved_tokens) of the shared nodes, by a second ROLLUP.

        A member that doesn't own the node saves the words from there to where it first owns one: a (words before that)
        less the words above the node, which all members have in common.
        """
        above = F.array(*(F.col("p0") + sum((F.coalesce(w, F.lit(0)) for w in self.ws[:i]), F.lit(0)) for i in range(self.width)))
        rows = self.rows.withColumn("ps", above).join(info.select("c", "a", "leaf"), "c")
        what = F.count("*").alias("n_convs"), F.min("c").alias("c"), F.sum("leaf").alias("n_leaves"), F.sum("a").alias("sum_a"), F.min_by("a", "c").alias("own_a"), F.min_by("ps", "c").alias("ps")
        before = F.when(F.col("d") == 0, F.lit(0)).otherwise(F.element_at("ps", F.greatest("d", F.lit(1))))
        saved = F.col("sum_a") - F.col("own_a") - (F.col("n_convs") - 1) * before
        return self.rollup(rows, *what).filter("n_convs > 1").select("c", (F.col("d") + self.start).cast("long").alias("pos"), "n_convs", "n_leaves", saved.alias("saved_tokens"))


def digests(ends: DataFrame) -> DataFrame:
    """(m, depth, ends_sha256) of ends (m, depth, c): SHA-256 of the ascending ids of a node, comma-joined.

    Ids are ranged over tasks, sorted and joined to pieces; a second pass streams the pieces of a node through one hash. A
    digest is sequential by nature: one task reads the pieces of a node, but holds one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"m": node[0], "depth": node[1], "c": ids[0], "piece": ",".join(map(str, ids))}], schema=pa.schema([("m", pa.int64()), ("depth", pa.int64()), ("c", pa.int64()), ("piece", pa.string())]))

        for b in batches:
            for m, depth, c in zip(*(b.column(n).to_pylist() for n in ("m", "depth", "c")), strict=True):
                if ids and (node != (m, depth) or len(ids) == PIECE):
                    yield out()
                    ids = []
                node = (m, depth)
                ids.append(c)
        if ids:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"m": node[0], "depth": node[1], "ends_sha256": state.hexdigest()}], schema=pa.schema([("m", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))

        for b in batches:
            for m, depth, piece in zip(*(b.column(n).to_pylist() for n in ("m", "depth", "piece")), strict=True):
                if node != (m, depth):
                    if state is not None:
                        yield out()
                    node, state = (m, depth), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
        if state is not None:
            yield out()

    ranged = ends.select("m", "depth", "c").repartitionByRange("m", "depth", "c").sortWithinPartitions("m", "depth", "c")
    joined = keep(ranged.mapInArrow(pieces, "m long, depth long, c long, piece string"), "trie-pieces")
    return joined.repartition("m", "depth").sortWithinPartitions("m", "depth", "c").mapInArrow(hashes, "m long, depth long, ends_sha256 string")


def trie(long: DataFrame, convs: DataFrame, first: int = FIRST, further: int = NEXT) -> DataFrame:
    """One row per node of the trie of the sequences long (c, pos from 1, t, w), all of them written tables; convs (c) also has those without turns.

    conv_id (the smallest member) and depth name a node; parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 as in the contract of op12. No conversations give no rows.
    """
    root = convs.agg(F.min("c")).first()[0]
    if root is None:
        return convs.selectExpr("c AS conv_id", "c AS depth", "c AS parent_conv_id", "c AS n_convs", "c AS n_children", "c AS n_leaves", "c AS saved_tokens", "'' AS ends_sha256")
    live, start, blocks = convs.select("c", F.lit(root).alias("prior"), F.lit(0).cast("long").alias("p0")), 0, []
    while not start or not live.isEmpty():
        blocks.append(Block(live, long, start, further if start else first))
        live, start = keep(blocks[-1].going_on(), "trie-live"), start + blocks[-1].width
    firsts = blocks[0].firsts()
    for b in blocks[1:]:
        firsts = firsts.unionByName(b.firsts())
    firsts = keep(firsts, "trie-owners")
    forks = keep(firsts.groupBy(F.col("up").alias("c"), (F.col("f") - 1).alias("pos")).agg(F.count("*").alias("forks")), "trie-forks")

    owner = F.when(F.col("c") == root, F.lit(0)).otherwise(F.coalesce("f", F.col("len") + 1))
    lengths = long.groupBy("c").agg(F.max("pos").cast("long").alias("len"))
    info = convs.select("c").join(lengths, "c", "left").withColumn("len", F.coalesce("len", F.lit(0))).join(firsts, "c", "left").withColumn("f", owner.cast("long"))
    info = keep(info.select("c", "len", F.greatest("len", F.lit(1)).alias("n"), "f", "up"), "trie-info")
    turns = keep(attach(long, info, ["c"], ["pos"]), "trie-long")
    apart = turns.filter("pos < f").groupBy("c").agg(F.sum("w").alias("a"))
    info = info.join(apart, "c", "left").join(forks.withColumnRenamed("pos", "len"), ["c", "len"], "left")
    info = keep(info.select("c", "len", "f", F.coalesce("a", F.lit(0)).alias("a"), ((F.col("f") <= F.col("len")) & F.col("forks").isNull()).cast("long").alias("leaf")), "trie-info")

    nodes = turns.filter("pos >= f").select("c", F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") == F.col("f"), F.col("up")).otherwise(F.col("c")).alias("parent_conv_id"), (F.col("len") > F.col("pos")).cast("long").alias("chain"), (F.col("len") == F.col("pos")).alias("at_end"))
    top = info.filter(F.col("c") == root).select("c", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("parent_conv_id"), (F.col("len") > 0).cast("long").alias("chain"), (F.col("len") == 0).alias("at_end"))
    copies = keep(info.filter("f > len").select("c", "len"), "trie-copies")
    ends = copies.filter("len = 0").select(F.lit(root).alias("m"), F.col("len").alias("depth"), "c")
    sums = blocks[0].sums(info)
    for i, b in enumerate(blocks):
        ends, sums = ends.unionByName(b.ends(copies)), sums.unionByName(b.sums(info)) if i else sums
    ends = keep(ends, "trie-ends")
    own = info.filter("f <= len").select(F.col("c").alias("m"), F.col("len").alias("depth"), "c").join(ends.select("m", "depth").distinct(), ["m", "depth"], "left_semi")
    shas = keep(digests(ends.unionByName(own)), "trie-digests").select(F.col("m").alias("c"), F.col("depth").alias("pos"), "ends_sha256")

    found = nodes.unionByName(top).join(sums, ["c", "pos"], "left").join(forks, ["c", "pos"], "left").join(shas, ["c", "pos"], "left")
    alone = F.sha2(F.when(F.col("at_end"), F.col("c").cast("string")).otherwise(""), 256)
    return found.select(
        F.col("c").alias("conv_id"), F.col("pos").alias("depth"), "parent_conv_id", F.coalesce("n_convs", F.lit(1)).alias("n_convs"), (F.col("chain") + F.coalesce("forks", F.lit(0))).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", alone).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, rebuild: bool = True, first: int = FIRST, further: int = NEXT) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text), rebuilt on shared heads unless told otherwise.

    Turns are ordered by turn (null first), then role, then the text's SHA-256; repeated rows are repeated turns. A null
    role or text is empty. Rows without a conv_id belong to no conversation and are left out. Other columns play no part;
    an empty table gives an empty result. Texts are read whole, and never leave the first stage.
    """
    rows = keep(placed(turns.select("conv_id", "turn", "role", "text")), "trie-placed")
    convs = keep(rows.groupBy("c").agg(F.count("*").alias("n")), "trie-convs")
    rows = keep(named(rows), "trie-named")
    long = keep(rebuilt(rows, convs), "trie-rebuilt") if rebuild else rows
    return trie(long, convs, first, further)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1))))"""
ORACLE = {
    "op12_prefix_trie": f"""
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base FROM turns GROUP BY conv_id),
        heads AS (SELECT *, xor({_CRC}, 4294967295) % 4 AS h FROM convs),
        long AS (
            SELECT c.conv_id, t.pos - h + least(h, coalesce(b.n, 0)) AS pos, role, txt
            FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > h LEFT JOIN convs b ON b.conv_id = c.base
            UNION ALL
            SELECT c.conv_id, t.pos, role, txt FROM heads c JOIN turns t ON t.conv_id = c.base AND t.pos <= h),
        paths AS (SELECT conv_id, list(struct_pack(role, txt) ORDER BY pos) AS s FROM long GROUP BY conv_id),
        step AS (
            SELECT conv_id, d AS depth, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS path, len(coalesce(s, [])) AS length,
                   CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(s[d].txt, '[^\\x20\\x09-\\x0D]+')) END AS w
            FROM (SELECT conv_id, s, unnest(range(0, len(coalesce(s, [])) + 1)) AS d FROM convs LEFT JOIN paths USING (conv_id))),
        member AS (SELECT conv_id, depth, length, w, min(conv_id) OVER p AS m, count(*) OVER p AS n FROM step WINDOW p AS (PARTITION BY depth, path)),
        node AS (
            SELECT m, depth, any_value(n) AS n_convs, any_value(w) AS w,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
            FROM member GROUP BY m, depth),
        edge AS (SELECT DISTINCT c.m, c.depth, p.m AS pm FROM member c JOIN member p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1),
        kids AS (SELECT pm AS m, depth - 1 AS depth, count(*) AS n_children FROM edge GROUP BY ALL),
        under AS (
            SELECT a.m, a.depth, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved_tokens
            FROM node v JOIN member a ON a.conv_id = v.m AND a.depth <= v.depth LEFT JOIN kids k ON k.m = v.m AND k.depth = v.depth GROUP BY a.m, a.depth)
        SELECT n.m AS conv_id, n.depth::BIGINT AS depth, e.pm AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
               u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM node n LEFT JOIN edge e ON e.m = n.m AND e.depth = n.depth LEFT JOIN kids k ON k.m = n.m AND k.depth = n.depth JOIN under u ON u.m = n.m AND u.depth = n.depth"""
}
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
