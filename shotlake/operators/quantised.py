"""Approximate neighbours from inverted lists of product-quantised residuals, with an exact second look.

k-means cells cut the space; a row lies in the list of its nearest cell, as the codes of what is left of it there. A query
visits its nearest cells, adds up table entries per code, and the best rows by that sum are compared exactly. How
many cells it visits follows from recall measured against exact neighbours.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.operators import vector
from shotlake.sources.stages import keep

#: Numbers in the sample that cells and codebooks are fitted on, cells at most, and components that one code stands for.
SAMPLE, MOST_CELLS, STEP = 4_000_000, 4096, 4
#: Rows of a cell that one task looks at; queries whose tables it holds; rows looked at exactly per neighbour wanted.
PART, BLOCK, AGAIN = 50_000, 128, 8
#: Queries that meet a cell's rows in one group; rows or visits of a batch that a task hands on.
ASKED, BATCH = 2048, 2048
#: Queries that the number of visited cells is measured with, and the recall asked of the cells.
MEASURED, RECALL = 200, 0.97


@dataclass
class Lists:
    """cells (n, dim), books (codes per part, 256, step); rows (cell, salt, doc, code) and vectors (doc, v), written; sizes (cell, n, salts)."""

    cells: np.ndarray
    books: np.ndarray
    rows: DataFrame
    vectors: DataFrame
    sizes: DataFrame
    counts: np.ndarray
    probes: int = 1


def _means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    middles = points[np.sort(rng.permutation(len(points))[:k])].copy()
    for _ in range(rounds):
        near = (points @ middles.T - (middles**2).sum(axis=1) / 2).argmax(axis=1)
        count = np.bincount(near, minlength=len(middles))
        sums = np.stack([np.bincount(near, points[:, j], minlength=len(middles)) for j in range(points.shape[1])], axis=1)
        middles = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], middles)
    return middles


def _codes(left: np.ndarray, books: np.ndarray) -> np.ndarray:
    step = books.shape[2]
    return np.stack([(left[:, p * step : (p + 1) * step] @ b.T - (b**2).sum(axis=1) / 2).argmax(axis=1) for p, b in enumerate(books)], axis=1).astype(np.uint8)


def _padded(points: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, books.shape[0] * books.shape[2] - points.shape[1])))


def _slices(rows: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    return (rows.iloc[at : at + size] for at in range(0, len(rows), size))


def build(vectors: DataFrame, cells: int | None = None) -> Lists:
    """Lists over vectors (doc, v), unit and of one length. The sample is bounded and drawn by a hash of doc; every row is in the lists."""
    vectors = keep(vectors.select("doc", "v"), "pq-vectors")
    n, first = vectors.count(), vectors.first()
    if first is None:
        raise ValueError("no vectors to index")
    dim = len(first["v"])
    take = max(256, SAMPLE // max(1, dim))
    sample = vectors if n <= take else vectors.filter(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < math.ceil((1 << 20) * take / n)).limit(take)
    points = np.array([r["v"] for r in sample.select("v").toLocalIterator()], float).reshape(-1, dim)
    k = min(cells or max(8, min(MOST_CELLS, math.isqrt(n))), len(points))
    middles = _means(points, k)
    near = (points @ middles.T - (middles**2).sum(axis=1) / 2).argmax(axis=1)
    parts = -(-dim // STEP)
    left = np.pad(points - middles[near], ((0, 0), (0, parts * STEP - dim)))
    books = np.stack([np.resize(b, (256, STEP)) for p in range(parts) for b in [_means(left[:, p * STEP : (p + 1) * STEP], min(256, len(left)))]])

    def encode(batches):
        for whole in batches:
            for b in _slices(whole, BATCH):
                v = np.array(b["v"].tolist(), float).reshape(len(b), dim)
                at = (v @ middles.T - (middles**2).sum(axis=1) / 2).argmax(axis=1)
                code = _codes(_padded(v - middles[at], books), books)
                yield pd.DataFrame({"cell": at.astype(np.int32), "doc": b["doc"], "code": [c.tobytes() for c in code]})

    kind = dict(vectors.dtypes)["doc"]
    coded = keep(vectors.mapInPandas(encode, f"cell int, doc {kind}, code binary"), "pq-coded")
    sizes = keep(coded.groupBy("cell").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / PART).cast("int")), "pq-sizes")
    rows = keep(coded.join(F.broadcast(sizes.select("cell", "salts")), "cell").select("cell", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), "doc", "code"), "pq-rows")
    counts = np.zeros(len(middles), np.int64)
    for r in sizes.collect():  # one row a cell
        counts[r["cell"]] = r["n"]
    return Lists(middles, books, rows, vectors, sizes, counts)


def visits(lists: Lists, queries: DataFrame, probes: int, least: int = 0) -> DataFrame:
    """(query_id, q, cell, turn): the cells of a query (query_id, q), nearest first; as many as probes says, and more until they hold `least` rows."""
    middles, counts = lists.cells, lists.counts
    kind = dict(queries.dtypes)

    def near(batches):
        for whole in batches:
            # a query leaves with its vector for every cell it visits, so a batch of queries is much larger when it leaves
            for b in _slices(whole, max(1, BATCH // max(1, min(probes, len(middles))))):
                q = np.array(b["q"].tolist(), float).reshape(len(b), middles.shape[1])
                order = np.argsort((middles**2).sum(axis=1) / 2 - q @ middles.T, axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1) - counts[order]
                row, turn = np.nonzero((np.arange(len(middles)) < probes) | (held < least))
                yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[row], "q": b["q"].to_numpy()[row], "cell": order[row, turn].astype(np.int32), "turn": turn.astype(np.int32)})

    return queries.select("query_id", "q").mapInPandas(near, f"query_id {kind['query_id']}, q {kind['q']}, cell int, turn int")


def measured(lists: Lists, k: int, recall: float = RECALL) -> Lists:
    """lists with as many probes as let the cells hold `recall` of the k nearest: MEASURED rows, drawn by a hash, against all rows exactly."""
    n = lists.vectors.count()
    some = lists.vectors.filter(F.pmod(F.xxhash64(F.lit(1), "doc"), F.lit(1 << 20)) < math.ceil((1 << 20) * MEASURED / n)).limit(MEASURED)
    asked = keep(some.select(F.col("doc").alias("query_id"), F.col("v").alias("q")), "pq-asked")
    exact = vector.nearest(asked, lists.vectors, k).select("query_id", "doc")
    turns = visits(lists, asked, len(lists.cells)).select("query_id", "cell", "turn")
    met = exact.join(lists.rows.select("doc", "cell"), "doc").join(turns, ["query_id", "cell"]).groupBy("turn").agg(F.count("*").alias("n")).orderBy("turn").collect()
    total, so_far, lists.probes = sum(r["n"] for r in met), 0, len(lists.cells)
    for r in met:
        so_far += r["n"]
        if so_far >= recall * total:
            lists.probes = r["turn"] + 1
            break
    return lists


def compared(lists: Lists, queries: DataFrame, k: int) -> float:
    """Share of all (query, row) pairs whose codes a search for k neighbours looks at."""
    n = lists.vectors.count() * queries.count()
    return (visits(lists, queries, lists.probes, k).join(F.broadcast(lists.sizes), "cell").agg(F.sum("n")).first()[0] or 0) / max(1, n)


def search(lists: Lists, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc, distance (1 - dot, exact) of the k nearest found; ties go to the smaller doc. No queries give no rows."""
    books, most = lists.books, AGAIN * k
    middles = lists.cells
    kind = dict(lists.rows.dtypes)["doc"], dict(queries.dtypes)["query_id"]

    def cell(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(v):
            v = v.sort_values("doc", ignore_index=True)
            codes = np.frombuffer(b"".join(v["code"]), np.uint8).reshape(len(v), len(books))
            for at in range(0, len(q), BLOCK):
                part = q.iloc[at : at + BLOCK]
                points = np.array(part["q"].tolist(), float)
                cut = _padded(points, books).reshape(len(part), books.shape[0], books.shape[2])
                tables = np.einsum("qps,pcs->qpc", cut, books)
                score = np.repeat((points @ middles[int(part["cell"].iloc[0])])[:, None], len(v), axis=1)
                for p in range(len(books)):
                    score += tables[:, p, :][:, codes[:, p]]
                few = min(most, len(v))
                best = np.argpartition(-score, few - 1, axis=1)[:, :few]
                found.append(pd.DataFrame({"query_id": part["query_id"].repeat(few).to_numpy(), "doc": v["doc"].to_numpy()[best.ravel()], "about": np.take_along_axis(score, best, axis=1).ravel()}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "doc": [], "about": []})

    queries = keep(queries.select("query_id", "q"), "pq-queries")
    asks = visits(lists, queries, lists.probes, k).join(F.broadcast(lists.sizes), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # a cell may be visited by nearly all queries: they are dealt, and each deal meets the cell's rows
    deals = max(1, -(-queries.count() // ASKED))
    asks = asks.select("query_id", "q", "cell", "salt", F.pmod(F.xxhash64("query_id"), F.lit(deals)).cast("int").alias("deal"))
    rows = lists.rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    keys = ["cell", "salt", "deal"]
    rough = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(cell, f"query_id {kind[1]}, doc {kind[0]}, about double")
    first = rough.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("about"), "doc"))).filter(F.col("r") <= most).select("query_id", "doc")
    sure = first.join(queries, "query_id").join(lists.vectors, "doc").withColumn("score", vector.dot(F.col("q"), F.col("v")))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc")
    return sure.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc", (F.round(1 - F.col("score"), 6) + 0.0).alias("distance"))
