"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of equal size that split few edges, and a small
classifier learns from it which parts hold a vector's neighbours. Every row is indexed under its most probable part;
a query goes to its most probable parts and is reranked there by exact inner products. How many parts a query needs is
measured: a few vectors outside that sample are compared with every row, and the fewest parts that give the wanted
recall are taken.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.llm.common import keep, table

TOP = 20
#: At most so many rows are sampled to fit the partition and the classifier, and so many others to measure recall.
SAMPLE, PROBES = 8192, 256
#: Pairs that are scored exactly at a time.
PAIRS = 1 << 16
#: The recall that the measured number of parts must reach on the probes; queries then come close to it.
WANTED_RECALL = 0.95
#: Rows of a part that the number of parts aims at, within these limits.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4096, 16, 512
#: A task compares about so many queries with so many rows.
CELL_QUERIES, CELL_ROWS = 1024, 2048


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k rows of largest inner product for each row, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(0, k)), np.int64)
    for at in range(0, len(x) if k > 0 else 0, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of equal size (parts is a power of two): halved along principal directions, then improved by swaps that keep more edges whole."""
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            centred = x[g] - x[g].mean(axis=0) if len(g) else x[g]
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1] if len(g) else 0
            order = g[np.argsort(centred @ axis, kind="stable")] if len(g) else g
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    for i, g in enumerate(groups):
        label[g] = i
    if not graph.size:
        return label
    a, b = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        ties = np.zeros((len(x), parts))
        np.add.at(ties, (a, label[b]), 1)
        np.add.at(ties, (b, label[a]), 1)
        own = ties[np.arange(len(x)), label]
        ties[np.arange(len(x)), label] = -1
        to = ties.argmax(axis=1)
        gain = ties[np.arange(len(x)), to] - own
        moved, before = 0, label.copy()
        for p in range(parts):
            for q in range(p + 1, parts):
                there = np.flatnonzero((before == p) & (to == q))
                back = np.flatnonzero((before == q) & (to == p))
                n = min(len(there), len(back))
                there, back = there[np.argsort(-gain[there], kind="stable")][:n], back[np.argsort(-gain[back], kind="stable")][:n]
                n = int(((gain[there] + gain[back]) > 0).sum() + 1) // 2  # half, as both ends of an edge may move
                label[there[:n]], label[back[:n]] = q, p
                moved += n
        if not moved:
            break
    return label


class Router:
    """A perceptron with one hidden layer: the probability that a vector's neighbours lie in each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 64, epochs: int = 40, rate: float = 3e-3, seed: int = 0):
        rng = np.random.default_rng(seed)
        d, parts = x.shape[1], target.shape[1]
        self.scale = 1 / max(1e-30, float(np.sqrt((x * x).mean())))
        self.w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts), rng.normal(0, 0.1 * d**-0.5, (d, parts))]
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                i = order[at : at + 256]
                xi = x[i] * self.scale
                h = np.maximum(0, xi @ self.w[0] + self.w[1])
                g = (self._softmax(h @ self.w[2] + self.w[3] + xi @ self.w[4]) - target[i]) / len(i)
                gh = (g @ self.w[2].T) * (h > 0)
                step += 1
                for j, grad in enumerate((xi.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0), xi.T @ g)):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.99 * v[j] + 0.01 * grad * grad
                    self.w[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """The parts, most probable first."""
        x = x * self.scale
        return np.argsort(-(np.maximum(0, x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3] + x @ self.w[4]), axis=1, kind="stable")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _top(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of each query's k best rows, ties to the smaller id; scores summed the same way wherever a pair is met."""
    s = q @ v.T
    s[qid[:, None] == vid[None, :]] = -np.inf
    last = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    slack = 1e-9 * (np.abs(last) + 1)
    i, j = np.nonzero((s >= np.where(np.isfinite(last), last - slack, -np.inf)[:, None]) & (s > -np.inf))
    exact = np.concatenate([(q[i[at : at + PAIRS]] * v[j[at : at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0)
    best = np.lexsort((vid[j], -exact, i))
    i, j, exact = i[best], j[best], exact[best]
    few = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[few], j[few], exact[few]


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: finite, not zero, of the commonest length, one for each non-null id (of several vectors, the smallest)."""
    e = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (most["d"] if most else 0))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = TOP, sample: int = SAMPLE, recall: float = WANTED_RECALL, part_rows: int = PART_ROWS) -> DataFrame:
    """vectors and queries: (vec_id, v), see valid(). Per query its k nearest rows found: query_id, rank, vec_id, score.

    A row is never its own neighbour. A query gets fewer than k only if there are fewer rows: it goes to as many parts
    as hold k others, the measured number at least. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    by_hash = vectors.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id")
    some = by_hash.limit(sample + PROBES).toPandas()
    result = "query_id long, rank int, vec_id long, score double"
    if not len(some):
        return spark.createDataFrame([], result)
    # the last ones of the sample only measure recall; a fifth of a small table
    tried = some.iloc[-max(1, min(PROBES, len(some) // 5)) :]
    x, asked_of = _matrix(some["v"].iloc[: max(1, len(some) - len(tried))]), _matrix(tried["v"])
    parts = 1 << int(np.ceil(np.log2(np.clip(n / part_rows, LEAST_PARTS, MOST_PARTS))))
    graph = neighbour_graph(x)
    label = balanced_partition(x, graph, parts)
    target = np.full((len(x), parts), 1e-3 / parts)
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1.0)
    router = spark.sparkContext.broadcast(Router(x, target / target.sum(axis=1, keepdims=True)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(part=router.value.ranked(_matrix(b["v"]))[:, 0].astype(np.int32) if len(b) else np.array([], np.int32))

    index = keep(vectors.mapInPandas(place, "vec_id long, v array<double>, part int"), "ann-index")
    sizes = dict(index.groupBy("part").count().collect())

    probes = spark.sparkContext.broadcast((asked_of, tried["vec_id"].to_numpy()))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i, j, s = _top(probes.value[0], probes.value[1], _matrix(b["v"]), b["vec_id"].to_numpy(), k)
            yield pd.DataFrame({"probe": i, "part": b["part"].to_numpy()[j], "vec_id": b["vec_id"].to_numpy()[j], "score": s})

    best = W.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    truth = index.mapInPandas(scan, "probe long, part int, vec_id long, score double").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("probe", "part").toPandas()
    place_of = np.argsort(router.value.ranked(asked_of), axis=1)
    depth = np.sort(place_of[truth["probe"], truth["part"]]) if len(truth) else np.array([0])
    need = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1

    size = np.array([sizes.get(p, 0) for p in range(parts)])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            order = router.value.ranked(_matrix(b["v"])) if len(b) else np.zeros((0, parts), np.int64)
            enough = (np.cumsum(size[order], axis=1) < k + 1).sum(axis=1) + 1
            yield b.assign(parts=[o[: max(need, e)].astype(np.int32).tolist() for o, e in zip(order, enough, strict=True)])

    routed = keep(queries.mapInPandas(route, "vec_id long, v array<double>, parts array<int>").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("parts").alias("part")), "ann-queries")
    asked = dict(routed.groupBy("part").count().collect())
    # a part's rows and queries are compared as a grid of cells, so a part may hold any share of either
    grid = lambda counts, per: F.element_at(F.array(*(F.lit(max(1, -(-counts.get(p, 0) // per))) for p in range(parts))), F.col("part") + 1)
    down, across = grid(sizes, CELL_ROWS), grid(asked, CELL_QUERIES)
    span = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    rows = index.withColumn("down", F.pmod(F.xxhash64("vec_id"), down).cast("int")).withColumn("across", span(across))
    asks = routed.withColumn("across", F.pmod(F.xxhash64("query_id"), across).cast("int")).withColumn("down", span(down))

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})
        qid, vid = q["query_id"].to_numpy(), v["vec_id"].to_numpy()
        i, j, s = _top(_matrix(q["q"]), qid, _matrix(v["v"]), vid, k)
        return pd.DataFrame({"query_id": qid[i], "vec_id": vid[j], "score": s})

    cell = ["part", "down", "across"]
    found = asks.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(valid(table(spark, sf_dir, "embeddings")), "ann-vectors")
    return neighbours(rows, rows.filter(F.col("vec_id") % 20 == 0))


ORACLE: dict[str, str] = {}
QUERIES = {"op4_ann": op4_ann}
