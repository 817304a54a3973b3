"""Toxicity of texts: subword-bag embeddings, averaged, under a linear softmax, all trained jointly in numpy.

A word is the bag of its character n-grams between end marks, a text the average of its words. Each n-gram's hash names
a vector; the vectors of a text's n-grams are averaged, and a linear softmax over the average gives the score. A misspelt
word that training never saw shares most n-grams, so most of the vector, with the word it stands for.

The model is fitted on a bounded sample of labelled rows, on the driver; every text is scored whole, inside tasks.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlake.llm.common import crc_of_id, keep, table, text_or_empty

#: Lengths of n-grams, buckets they are hashed to, and components of a vector.
LENGTHS, BUCKETS, DIM = (3, 4, 5, 6), 1 << 18, 8
#: The sample that the classifier is fitted on: rows of each label, and (bucket, weight) pairs of all of them together.
SAMPLE_ROWS, SAMPLE_PAIRS = 3000, 16_000_000
#: Buckets in fewer sampled texts, or whose mean weights in both classes lie fewer standard errors apart, teach nothing.
LEAST_TEXTS, LEAST_APART = 3, 2.5
#: The softmax's first weight on the first component; passes over the sample; texts in a step; step; pull of the vectors towards zero.
FIRST_GAIN, EPOCHS, BATCH, STEP, DECAY = 300.0, 20, 64, 0.05, 1e-4
#: A task forgets the words it knows beyond so many.
KEPT_WORDS = 300_000
#: Characters of a word that are looked at together; a longer run is that many pieces.
LONGEST = 64


def words(text: str) -> list[str]:
    """Lower-cased runs between blanks, without the punctuation around them; very long runs in pieces."""
    found = []
    for run in text.lower().split():
        if not run.isalnum():
            a, b = 0, len(run)
            while a < b and not run[a].isalnum():
                a += 1
            while b > a and not run[b - 1].isalnum():
                b -= 1
            run = run[a:b]
        if len(run) <= LONGEST:
            if run:
                found.append(run)
        else:
            found += [run[i : i + LONGEST] for i in range(0, len(run), LONGEST)]
    return found


def buckets(some: list[str], size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word between end marks, and the index of their word. A word shorter than n has itself as the only n-gram."""
    line = np.frombuffer(("<" + "><".join(some) + ">").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in some]) + 2
    owner = np.repeat(np.arange(len(some)), lengths)
    found, owners = [], []
    key = line * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(LENGTHS) + 1):
        key = (key[:-1] ^ (key[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + line[n - 1 :] * np.uint64(0x94D049BB133111EB)
        if n in LENGTHS:
            inside = owner[: len(key)] == owner[n - 1 :]
            found.append(key[inside])
            owners.append(owner[: len(key)][inside])
        if len(key) < 2:
            break
    mixed = np.concatenate(found) if found else np.zeros(0, np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def bag(text: str, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their weights, which add up to 1 (for a text without words: none): n-grams averaged in words, words in the text."""
    count: dict[str, int] = {}
    for w in words(text):
        count[w] = count.get(w, 0) + 1
    if not count:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    total = np.zeros(size)
    distinct = list(count)
    for at in range(0, len(distinct), 20_000):
        some = distinct[at : at + 20_000]
        ids, owner = buckets(some, size)
        each = np.bincount(owner, minlength=len(some))
        total += np.bincount(ids, np.array([count[w] for w in some])[owner] / each[owner], minlength=size)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / sum(count.values())).astype(np.float32)


@dataclass
class Model:
    """A text's logit is bias plus the mean, over its words, of the mean of its n-grams' gains: a vector times the softmax's difference of classes."""

    gains: np.ndarray
    bias: float

    def of_words(self, some: list[str]) -> np.ndarray:
        ids, owner = buckets(some, len(self.gains))
        return np.bincount(owner, self.gains[ids], minlength=len(some)) / np.maximum(1, np.bincount(owner, minlength=len(some)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, size: int = BUCKETS, dim: int = DIM, seed: int = 1) -> Model:
    """Vectors (size, dim) and softmax weights (dim, 2), trained together on the bags by mini-batches with steps scaled per weight (Adagrad).

    share: part of all labelled texts that are toxic; the sample may be balanced, so classes are weighed back to it. The first
    component starts as the difference of an n-gram's mean weights in both classes over their sum, less where it is
    uncertain; the others start at random. Without texts of both labels the share alone is the score.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(size), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    # by class: how many texts, and mean and variance of each bucket's weight over them
    n, stats, texts = [], [], np.zeros(size, np.int64)
    for y in (0, 1):
        sums = np.zeros((2, size))
        for i, w in (b for b, z in zip(bags, labels, strict=True) if z == y):
            sums[0][i] += w
            sums[1][i] += w.astype(np.float64) ** 2
            texts[i] += 1
        n.append(int((labels == y).sum()))
        stats.append((sums[0] / n[y], sums[1] / n[y] - (sums[0] / n[y]) ** 2))
    apart = (stats[1][0] - stats[0][0]) / np.sqrt(stats[1][1] / n[1] + stats[0][1] / n[0] + 1e-16)
    seen = np.flatnonzero((texts >= min(LEAST_TEXTS, len(bags))) & (np.abs(apart) >= LEAST_APART))
    place = np.full(size, -1, np.int64)
    place[seen] = np.arange(len(seen))
    kept = [(place[i[m]], w[m]) for i, w in bags for m in [place[i] >= 0]]
    certain = apart[seen] ** 2 / (apart[seen] ** 2 + 9)
    ratio = certain * (stats[1][0] - stats[0][0])[seen] / (stats[1][0] + stats[0][0])[seen]
    vectors = rng.normal(0, 0.01, (len(seen), dim))
    vectors[:, 0] = ratio
    soft = np.zeros((dim, 2))
    soft[0] = -FIRST_GAIN, FIRST_GAIN
    bias = np.array([0.0, np.log(share / (1 - share))])
    weight = np.where(labels == 1, share / (labels == 1).mean(), (1 - share) / (labels == 0).mean())
    squares = [np.full_like(vectors, 1e-8), np.full_like(soft, 1e-2), np.full_like(bias, 1e-2)]
    for _ in range(EPOCHS):
        turn = rng.permutation(len(kept))
        for at in range(0, len(turn), BATCH):
            some = turn[at : at + BATCH]
            ids, w = np.concatenate([kept[k][0] for k in some]), np.concatenate([kept[k][1] for k in some])
            row = np.repeat(np.arange(len(some)), [len(kept[k][0]) for k in some])
            drawn = vectors[ids] * w[:, None]
            mean = np.stack([np.bincount(row, drawn[:, j], minlength=len(some)) for j in range(dim)], axis=1)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= weight[some][:, None] / len(some)
            back = p @ soft.T
            used, at_used = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(at_used, w * back[row, j], minlength=len(used)) for j in range(dim)], axis=1) + DECAY * vectors[used] / len(kept)
            squares[0][used] += grad**2
            vectors[used] -= STEP * grad / np.sqrt(squares[0][used])
            for value, g, s in ((soft, mean.T @ p, squares[1]), (bias, p.sum(axis=0), squares[2])):
                s += g**2
                value -= STEP * g / np.sqrt(s)
    gains = np.zeros(size)
    gains[seen] = vectors @ (soft[:, 1] - soft[:, 0])
    return Model(gains, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, pairs: int = SAMPLE_PAIRS) -> Model:
    """The model of the labelled texts. Of each label up to `rows` documents, chosen by a hash of the id, and of these as many as have `pairs` pairs together.

    Labels other than 0 and 1 teach nothing; a document that is labelled both ways counts as toxic.
    """
    given = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc")).agg(F.max(label).cast("int").alias("y"))
    given = keep(given, "tox-labels")
    n = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    order = [F.xxhash64("doc"), F.col("doc")]
    chosen = [given.filter(F.col("y") == y).orderBy(*order).limit(rows) for y in (0, 1)]
    sample = keep(chosen[0].unionByName(chosen[1]), "tox-sample")
    texts = docs.select(F.col(doc_id).alias("doc"), text_or_empty(text).alias("text")).join(F.broadcast(sample), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [bag(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("y"), pa.array([len(f[0]) for f in found], pa.int32()), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["doc", "y", "n", "ids", "weights"])

    kind = T.StructType([T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("y", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("weights", T.BinaryType())])
    # ids may repeat in documents: of the rows of one, the first by content stands for it
    bags = keep(texts.mapInArrow(run, kind).groupBy("doc", "y").agg(F.min_by(F.struct("n", "ids", "weights"), F.xxhash64("ids", "weights")).alias("b")).select("doc", "y", "b.*"), "tox-bags")
    held, y, left = [], [], pairs
    for r in bags.orderBy(F.xxhash64("doc"), "doc").toLocalIterator():
        left -= r["n"]
        if left < 0:
            break
        held.append((np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float32)))
        y.append(r["y"])
    return fit(held, np.array(y, np.int64), n.get(1, 0) / max(1, sum(n.values())) if n else 0.0)


def score(docs: DataFrame, model: Model, text: str = "text", columns: tuple[str, str] = ("score", "predicted"), without: tuple[str, ...] = ()) -> DataFrame:
    """docs, less the columns `without`, with the score (0 to 1) and its class (1 from 0.5).

    Whole texts are read, in any length; a null, empty or wordless text has the score of the model's bias. Empty tables
    stay empty, repeated rows get equal scores; other columns pass as they are, but for those named as `columns` are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    gone = {c.lower() for c in columns}
    rest = [f for f in docs.schema.fields if f.name not in without and f.name.lower() not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            logits = []
            for t in b.column(text):
                found = words(t.as_py() or "")
                new = list({w for w in found if w not in known})
                for at in range(0, len(new), 20_000):
                    known.update(zip(new[at : at + 20_000], shared.value.of_words(new[at : at + 20_000]).tolist(), strict=True))
                logits.append(shared.value.bias + (sum(map(known.__getitem__, found)) / len(found) if found else 0.0))
                if len(known) > KEPT_WORDS:
                    known.clear()
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits), -700, 700)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], names=[*(f.name for f in rest), *columns])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(columns[0], T.DoubleType()), T.StructField(columns[1], T.IntegerType())]))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(crc_of_id(doc_id), F.lit(5)) == 0


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, without=("text",))


ORACLE: dict[str, str] = {}
QUERIES = {"op11_toxicity": op11_toxicity}
