"""Near duplicates by SimHash fingerprints and anchor-point covering.

The 64 bits are cut into three bands. Two fingerprints that differ in at most 5 bits differ in at most one bit of some
band. A band's anchors are the points of a covering code: the words of the [15, 11] Hamming code (covering radius 1)
on its low 15 bits, joined with every value of the bits above. Each fingerprint is at home at its nearest anchor, and
a member at every anchor within the covering radius plus one bit; whoever differs from it by one bit in that band is
among the members of its home. There they are compared in blocks, and each block hands on a spanning forest of its
links, never all pairs of a group.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm.common import attach, components, keep, table, text_or_empty

SHINGLE_WORDS = 4
MAX_BITS = 4
#: (lowest bit, bits) of the bands; each has 15 coded bits, then plain ones.
BANDS = ((0, 22), (22, 21), (43, 21))
CODED = 15
#: A cell of an anchor compares about so many homes with so many members at a time.
HOMES, MEMBERS = 2048, 4096
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """The SimHash of a text: A-Z lower-cased, words between ASCII white space, shingles with repeats; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    stops, digest, n = (ends[shingle - 1 :] - 1).tolist(), xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * int(ones[i]) > n))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": fp})

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id string, text_hash long, fp long").withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def _syndrome(coded: Column) -> Column:
    """Which position (1 to 15) of the Hamming code is off; 0 for a code word. Bit i of the word is position i + 1."""
    out = F.lit(0)
    for k in range(4):
        mask = sum(1 << (p - 1) for p in range(1, CODED + 1) if p >> k & 1)
        out = out + F.shiftleft(F.bit_count(coded.bitwiseAND(F.lit(mask))) % 2, k)
    return out


def _errors(syndrome: int) -> list[int]:
    """The error patterns of at most two bits with this syndrome."""
    bit = lambda p: 1 << (p - 1)
    if not syndrome:
        return [0]
    return [bit(syndrome)] + [bit(p) | bit(p ^ syndrome) for p in range(1, CODED + 1) if p < p ^ syndrome]


def _anchors(fp: Column, band: int) -> Column:
    """Array of (anchor, home): the fingerprint's home first, then the other anchors within radius 1 + 1 of it in this band."""
    low, bits = BANDS[band]
    value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
    coded, plain = value.bitwiseAND(F.lit((1 << CODED) - 1)), F.shiftrightunsigned(value, CODED)
    errors = F.element_at(F.array(*(F.array(*(F.lit(e).cast("long") for e in _errors(s))) for s in range(1 << 4))), (_syndrome(coded) + 1).cast("int"))
    at = lambda p, c: F.shiftleft(F.lit(band).cast("long"), 40).bitwiseOR(F.shiftleft(p, CODED)).bitwiseOR(c)
    near = F.transform(errors, lambda e, i: F.struct(at(plain, coded.bitwiseXOR(e)).alias("key"), (i == 0).alias("home")))
    home = coded.bitwiseXOR(errors[0])
    flips = F.transform(F.array(*(F.lit(1 << i).cast("long") for i in range(bits - CODED))), lambda f: F.struct(at(plain.bitwiseXOR(f), home).alias("key"), F.lit(False).alias("home")))
    return F.concat(near, flips)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the edges a[i] - b[i]: one row for each node that isn't its own root."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(new, end, low)
        while (next_ := new[new])[0] != new[0] or not np.array_equal(next_, new):
            new = next_
        if np.array_equal(new, label):
            off = label != np.arange(len(nodes))
            return nodes[off], nodes[label[off]]
        label = new


def _compare(cells: pd.DataFrame, most: int) -> pd.DataFrame:
    """A spanning forest of the links between homes and members of the same cell; cells come sorted by cell, homes first."""
    cell, home, fp = cells["cell"].to_numpy(), cells["home"].to_numpy(), cells["fp"].to_numpy()
    new = np.concatenate(([True], cell[1:] != cell[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(cell)))
    group = np.cumsum(new) - 1
    rows = np.flatnonzero(home)
    width, first = size[group[rows]], start[group[rows]]
    ends, us, vs = np.cumsum(width), [], []
    lo = 0
    while lo < len(rows):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        w = width[lo:hi]
        left = np.repeat(rows[lo:hi], w)
        right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[lo:hi], w)
        x, y = fp[left], fp[right]
        near = (np.bitwise_count((x ^ y).view(np.uint64)) <= most) & (x != y)
        if near.any():
            u, v = forest(x[near], y[near])
            us.append(u), vs.append(v)
        lo = hi
    if not us:
        return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
    u, v = forest(np.concatenate(us), np.concatenate(vs))
    return pd.DataFrame({"u": u, "v": v})


def links(prints: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect exactly those of the distinct fingerprints `fp` which links of at most `most` bits connect."""
    if not 0 <= most <= 5:
        raise ValueError("three bands cover at most 5 differing bits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, held = [], 0
        for b in batches:
            rest.append(b)
            held += len(b)
            if held < 200_000:
                continue
            whole = pd.concat(rest, ignore_index=True)
            last = int(np.searchsorted((whole["cell"] == whole["cell"].iloc[-1]).to_numpy(), True)) if len(whole) else 0
            if last:
                yield _compare(whole.iloc[:last], most)
            rest = [whole.iloc[last:]]
            held = len(rest[0])
        if rest and held:
            yield _compare(pd.concat(rest, ignore_index=True), most)

    spread = prints.select("fp", F.explode(F.concat(*(_anchors(F.col("fp"), k) for k in range(len(BANDS))))).alias("a")).select("fp", F.col("a.key").alias("key"), F.col("a.home").alias("home"))
    sizes = keep(spread.groupBy("key").agg(F.count("*").alias("members"), F.count_if("home").alias("homes")), "sh-anchors")
    # every anchor of more than MEMBERS rows is compared as a grid of cells, however many anchors that are
    large = sizes.filter(F.col("members") > MEMBERS).select("key", F.col("members").alias("n"), F.ceil(F.col("members") / MEMBERS).cast("int").alias("ms"), F.ceil(F.greatest(F.col("homes"), F.lit(1)) / HOMES).cast("int").alias("hs"))
    cells = attach(spread, large, ["key"], ["fp"]).fillna(1, ["ms", "hs"]) if not large.isEmpty() else spread.withColumn("ms", F.lit(1)).withColumn("hs", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), F.col("ms")), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("hs"))
    span = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    grid = F.col("ms") * F.col("hs") > 1
    whole = cells.filter(~grid).withColumn("h", F.lit(0)).withColumn("m", F.lit(0))
    # in a grid every fingerprint is a member of a column for each row of homes, and those at home are homes of a row for each column
    members = cells.filter(grid).withColumn("home", F.lit(False)).withColumn("h", F.explode(span(F.col("hs")))).withColumn("m", mine[0])
    homes = cells.filter(grid & F.col("home")).withColumn("h", mine[1]).withColumn("m", F.explode(span(F.col("ms"))))
    cols = ["key", "h", "m", "home", "fp"]
    cells = whole.select(cols).unionByName(members.select(F.col("key"), "h", F.col("m").cast("int").alias("m"), "home", "fp")).unionByName(homes.select("key", F.col("h").cast("int").alias("h"), "m", "home", "fp"))
    cells = cells.select(F.xxhash64("key", "h", "m").alias("cell"), "home", "fp")
    edges = cells.repartition("cell").sortWithinPartitions("cell", F.desc("home")).mapInPandas(run, "u long, v long")
    return keep(edges, "sh-links")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, and first (none, id, text_hash): the row of its component with the smallest id, null ids last."""
    rows = keep(fingerprints(docs, doc_id, text, shingle), "sh-prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_hash")
    prints = keep(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(first).alias("first")), "sh-distinct")
    # ids in random order keep the rounds few
    edges = keep(links(prints.select("fp"), most).select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")), "sh-edges")
    roots = components(edges)
    placed = keep(prints.withColumn("node", F.xxhash64("fp")).join(roots, "node", "left").select("fp", "n", "first", F.coalesce("root", "node").alias("root")), "sh-placed")
    groups = keep(placed.groupBy("root").agg(F.count("*").alias("n"), F.min("first").alias("least")), "sh-groups")
    named = keep(attach(placed, groups, ["root"], ["fp"]).select("fp", "n", F.col("least").alias("first")), "sh-named")
    return attach(rows, named, ["fp"], ["doc_id", "text_hash"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Null and empty texts have fingerprint 0 and link like others; repeated rows stay repeated; a component of null ids
    only has a null id. Long texts are read whole, in chunks of shingles. An empty table gives an empty result.
    """
    groups = near_groups(docs, doc_id, text, shingle, most)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op9_simhash": op9_simhash}
