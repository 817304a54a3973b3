"""Vector codes from codebooks that k-means fits exactly, by anchors-hierarchy metric trees over the parts of vectors.

Vectors are dealt in chunks; over each part of a chunk's vectors stands a tree of balls, built middle-out: about sqrt(n)
anchors, each taking the points that are nearer to it than to its owner before, are joined pairwise upwards and
built out downwards the same way. A ball caches how many points it holds, their sum and their reach. Every pass hands the
list of entries down the tree: an entry leaves it where the bisector with the nearest one lies beyond the ball, and
a ball with one entry left goes to it as a whole, by its cached sum and count. Trees are built once and serve all passes.
"""

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlake.llm.common import attach, fresh, keep, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a chunk, and points that a ball holds at most without balls below.
CHUNK, LEAF = 4096, 24


@dataclass
class Tree:
    """Points (n, dim) in the order of the balls; ball i holds the points first[i] to last[i], and the balls below it are low[i] and high[i] (-1: none)."""

    points: np.ndarray
    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def _ball(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Pivot (the mean, rounded), radius and sum of a set of points."""
    here = points[rows]
    total = here.sum(axis=0)
    pivot = np.rint(total / len(rows))
    return pivot, math.sqrt(float(((here - pivot) ** 2).sum(axis=1).max(initial=0.0))) * (1 + 1e-12), total


def _anchors(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """rows in about sqrt(n) sets. A new anchor is the point furthest from its own; only points beyond half the way to it can change."""
    here = points[rows]
    start = int(((here - here.mean(axis=0)) ** 2).sum(axis=1).argmin())
    anchors, owner = [start], np.zeros(len(rows), np.int64)
    dist = np.sqrt(((here - here[start]) ** 2).sum(axis=1))
    while len(anchors) < math.isqrt(len(rows) - 1) + 1:
        new = int(dist.argmax())
        if dist[new] == 0:
            break
        apart = np.sqrt(((here[anchors] - here[new]) ** 2).sum(axis=1))
        reach = np.flatnonzero(dist > apart[owner] / 2)
        nearer = np.sqrt(((here[reach] - here[new]) ** 2).sum(axis=1))
        taken = nearer < dist[reach]
        owner[reach[taken]], dist[reach[taken]] = len(anchors), nearer[taken]
        anchors.append(new)
    by = np.argsort(owner, kind="stable")
    return [rows[x] for x in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1)]


def _grow(points: np.ndarray, rows: np.ndarray, leaf: int) -> tuple:
    """(rows, ball, low, high), nested: the hierarchy of a set of points."""
    ball = _ball(points, rows)
    if len(rows) <= leaf or ball[1] == 0:
        return rows, ball, None, None
    nodes = [_grow(points, x, leaf) for x in _anchors(points, rows)]
    if len(nodes) == 1:
        return rows, ball, None, None
    # the two balls that one smallest ball would hold are joined, until one is left
    pivots, radii = np.array([n[1][0] for n in nodes]), np.array([n[1][1] for n in nodes])
    reach = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2)) + radii[:, None] + radii[None]
    reach[np.tril_indices(len(nodes))] = np.inf
    for _ in range(len(nodes) - 1):
        a, b = divmod(int(reach.argmin()), len(nodes))
        both = np.concatenate([nodes[a][0], nodes[b][0]])
        nodes[a] = both, _ball(points, both), nodes[a], nodes[b]
        pivots[a], radii[a] = nodes[a][1][0], nodes[a][1][1]
        reach[b, :], reach[:, b] = np.inf, np.inf
        left = np.isfinite(reach[a]) | np.isfinite(reach[:, a])
        far = np.sqrt(((pivots - pivots[a]) ** 2).sum(axis=1)) + radii + radii[a]
        at = np.arange(len(nodes))
        reach[a, left & (at > a)], reach[left & (at < a), a] = far[left & (at > a)], far[left & (at < a)]
    return nodes[a]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over points (n, dim), whole numbers; n is 1 at least."""
    exact = points.astype(np.float64)
    order, flat, stack = [], [], [(_grow(exact, np.arange(len(points)), leaf), -1, 0)]
    while stack:  # depth first, so that a ball's points stand together
        (rows, ball, low, high), above, side = stack.pop()
        if above >= 0:
            flat[above][2 + side] = len(flat)
        flat.append([sum(map(len, order)) if low is None else -1, len(rows), -1, -1, ball])
        if low is None:
            order.append(rows)
        else:
            stack += [(high, len(flat) - 1, 1), (low, len(flat) - 1, 0)]
    for node in reversed(flat):
        if node[0] < 0:
            node[0] = flat[node[2]][0]
    by = np.concatenate(order)
    first, count, low, high = (np.array([n[i] for n in flat], np.int64) for i in range(4))
    pivot, radius = np.array([n[4][0] for n in flat]).reshape(len(flat), -1), np.array([n[4][1] for n in flat])
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[by].astype(np.int64), axis=0)])
    return Tree(points[by], by, first, first + count, low, high, pivot, radius, sums[first + count] - sums[first])


@dataclass
class Entries:
    """One part's codebook (entries, dim), with the first of equal entries and the distances between entries."""

    values: np.ndarray

    def __post_init__(self):
        self.exact = self.values.astype(np.float64)
        self.alone = np.sort(np.unique(self.values, axis=0, return_index=True)[1])  # of equal entries the first takes all
        self.apart = np.sqrt(((self.exact[:, None] - self.exact[None]) ** 2).sum(axis=2))
        self.squares = (self.exact**2).sum(axis=1)


def distances(points: np.ndarray, entries: Entries, which: np.ndarray) -> np.ndarray:
    """Exact squared distances (points, which) as whole numbers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries.values[which]).max(initial=0)))
    if points.shape[1] * (2 * most) ** 2 < 1 << 52:
        p = points.astype(np.float64)
        return ((p**2).sum(axis=1)[:, None] - 2 * (p @ entries.exact[which].T) + entries.squares[which]).astype(np.int64)
    return ((points.astype(np.int64)[:, None] - entries.values[which][None]) ** 2).sum(axis=2)


def assign(tree: Tree, entries: Entries, whole: Callable[[int, int], None], single: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None]) -> int:
    """Hands the entries down the tree. whole(ball, entry): all points of the ball are nearest to entry. single(ball, entry of each point, its distance, which).

    Ties go to the lower entry. The number of balls handed over whole is returned.
    """
    owned, stack = 0, [(0, entries.alone)]
    while stack:
        ball, which = stack.pop()
        far = ((entries.exact[which] - tree.pivot[ball]) ** 2).sum(axis=1)
        best = int(far.argmin())
        # beyond the ball: no point of it reaches the bisector of this entry and the best
        slack = 2 * tree.radius[ball] * entries.apart[which[best], which] * (1 + 1e-9) + 1e-9 * (far + 1)
        left = far - far[best] <= slack
        left[best] = True
        which = which[left]
        if len(which) == 1:
            owned += 1
            whole(ball, int(which[0]))
        elif tree.low[ball] < 0:
            d = distances(tree.points[tree.first[ball] : tree.last[ball]], entries, which)
            at = d.argmin(axis=1)
            single(ball, which[at], d[np.arange(len(d)), at], which)
        else:
            stack += [(int(tree.low[ball]), which), (int(tree.high[ball]), which)]
    return owned


def added(tree: Tree, entries: Entries, sums: np.ndarray, counts: np.ndarray) -> int:
    """Adds each point to the sums and counts of its nearest entry."""

    def whole(ball: int, entry: int) -> None:
        sums[entry] += tree.total[ball]
        counts[entry] += tree.last[ball] - tree.first[ball]

    def single(ball: int, near: np.ndarray, _: np.ndarray, __: np.ndarray) -> None:
        np.add.at(sums, near, tree.points[tree.first[ball] : tree.last[ball]].astype(np.int64))
        np.add.at(counts, near, 1)

    return assign(tree, entries, whole, single)


def coded(tree: Tree, entries: Entries) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, and its squared distance, in the points' first order."""
    code, error = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), np.int64)

    def whole(ball: int, entry: int) -> None:
        rows = slice(tree.first[ball], tree.last[ball])
        code[tree.order[rows]], error[tree.order[rows]] = entry, distances(tree.points[rows], entries, np.array([entry]))[:, 0]

    def single(ball: int, near: np.ndarray, far: np.ndarray, _: np.ndarray) -> None:
        rows = tree.order[tree.first[ball] : tree.last[ball]]
        code[rows], error[rows] = near, far

    assign(tree, entries, whole, single)
    return code, error


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v: floors of the scaled components) of the vectors that take part, and their length."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(F.col(vector).isNotNull() & ok)
    dim = kept.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dim is None:
        return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<long>").alias("v")), 0
    most = math.isqrt((1 << 62) // max(1, dim["dim"])) // 2
    floor = F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * scale))))
    rows = kept.filter(F.size(vector) == dim["dim"]).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), floor.cast("array<long>").alias("v"))
    return rows, dim["dim"]


def chunks(rows: DataFrame, dim: int, parts: int, size: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """(ids, labels, trees): chunks of `size` vectors of a task with the pickled tree of each part."""
    cuts = [i * dim // parts for i in range(parts + 1)] if dim % parts == 0 else [min(dim, i * -(-dim // parts)) for i in range(parts + 1)]
    labels = rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v = t.column("v").combine_chunks()
            points = v.flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim)
            trees = pickle.dumps([build(points[:, a:b], leaf) for a, b in zip(cuts, cuts[1:], strict=False)])
            one = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).combine_chunks()) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*one, pa.array([trees], pa.binary())], names=["ids", "labels", "trees"])

        for b in batches:
            while b.num_rows:
                room = size - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in held) == size:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return rows.mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(labels)), T.StructField("trees", T.BinaryType())]))


def update(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: the floor of the mean of what is nearest to each entry; entries without a point stay. Tasks add up their balls; the driver gets one row an entry."""
    shared = trees.sparkSession.sparkContext.broadcast(books)
    dim = max(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Entries(b) for b in shared.value]
        sums, counts = [np.zeros_like(b) for b in shared.value], [np.zeros(len(b), np.int64) for b in shared.value]
        for b in batches:
            for blob in b.column("trees"):
                for p, tree in enumerate(pickle.loads(blob.as_py())):
                    added(tree, entries[p], sums[p], counts[p])
        found = [(p, int(e), int(counts[p][e]), [*sums[p][e].tolist(), *[0] * (dim - sums[p].shape[1])]) for p in range(len(sums)) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "s"])

    rows = trees.select("trees").mapInArrow(run, "part int, entry int, n long, s array<long>")
    new = [b.copy() for b in books]
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim))).collect():
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books[r["part"]].shape[1])]
    return new


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Components become floor(scale * x). Codebooks start as the parts of the smallest ids (null last; of equal ids, the smaller vector first) and
    are improved by `rounds` exact rounds of k-means, ties to the lower entry. Vectors that are null or hold null or
    non-finite components are left out, and those of another length than the commonest (of equally common ones, the longest).
    If the length is no multiple of `parts`, the last part is shorter. So that errors fit in a long, components count as
    isqrt(2^62 / length) / 2 at most (2^27 for 64). Repeated rows and null ids stay; other columns play no part; an empty table gives an empty result.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries")
    rows, dim = whole_vectors(vectors, vec_id, vector, label, scale)
    firsts = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not firsts:
        return rows.selectExpr("vec_id", "'' AS code", "vec_id AS error", "vec_id AS label_error", "'' AS codebooks_sha256").filter("false")
    trees = keep(chunks(rows, dim, parts), "pq-trees")
    step = -(-dim // parts)
    books = [np.array(firsts, np.int64).reshape(len(firsts), dim)[:, i * step : (i + 1) * step] for i in range(parts)]
    for _ in range(rounds):
        books = update(trees, books)
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = [Entries(b) for b in shared.value]
        for b in batches:
            for i in range(b.num_rows):
                found = [coded(t, e) for t, e in zip(pickle.loads(b.column("trees")[i].as_py()), book, strict=True)]
                codes = ["".join(f"{int(c):02x}" for c in each) for each in zip(*(f[0] for f in found), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    out = trees.mapInArrow(run, T.StructType([T.StructField("vec_id", T.LongType()), rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    (key,) = fresh(out.columns, "_key")
    out = keep(out.select("vec_id", "code", "error", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias(key)), "pq-codes")
    sums = keep(out.groupBy(key).agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "pq-labels")
    return attach(out, sums, [key], ["vec_id", "code"]).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """k-means as SQL: every part against every entry, five times. Vectors of these tables have 64 components."""
    dim = 64 // PARTS
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS (SELECT rn, p, v[p * {dim} + 1 : (p + 1) * {dim}] AS x FROM kept, range({PARTS}) AS r(p))",
        f"book0 AS (SELECT p, rn - 1 AS e, x AS y FROM part WHERE rn <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"far{i} AS MATERIALIZED (SELECT rn, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT rn, part.p, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN book{i} b ON b.p = part.p) GROUP BY rn, p)")
        if i < ROUNDS:
            steps.append(f"mean{i} AS (SELECT p, e, list(m ORDER BY j) AS y FROM (SELECT p, e, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS m FROM far{i} JOIN part USING (rn, p), range(1, {dim + 1}) AS r(j) GROUP BY p, e, j) GROUP BY p, e)")
            steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e)")
    return f"""
        WITH {", ".join(steps)},
        coded AS (SELECT rn, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM far{ROUNDS} GROUP BY rn),
        sha AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
        SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rn), sha"""


ORACLE = {"op13_vector_codes": _oracle()}
QUERIES = {"op13_vector_codes": op13_vector_codes}
