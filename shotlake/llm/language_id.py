"""Language identification by language-bitmask n-gram filters.

Training counts the letter n-grams of each language over every training text. An n-gram belongs to a language if it is
not much rarer there than in the language where it is most common. All languages share one bit-sliced Bloom filter: a
position holds a bit per language, an n-gram sets its languages' bits at a few hashed positions, and one lookup (the
AND of these positions) gives every language that contains it. A text's popcount per language, corrected for the
filter's rate of false positives in that language, decides.

N-grams never cross words, so words are scored once per task and looked up afterwards; the numbers are the same.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlake.llm.common import crc_of_id, keep, table

NGRAM = 4
#: Hashes per n-gram, and languages per plane of 64-bit masks.
HASHES, PLANE = 4, 60
#: The filter has the power of two of positions, between these, that gives the largest language's n-grams ROOM each.
LEAST_POSITIONS, MOST_POSITIONS, ROOM = 1 << 20, 1 << 24, 8
#: An n-gram is dropped from languages where its share is below this part of its largest share, or below LEAST: so a
#: language holds at most 1 / LEAST n-grams, which set under 2/5 of MOST_POSITIONS: false positives stay below 1 in 40.
RARER, LEAST = 0.1, 5e-7
#: Positions that travel to the driver as one block of bytes.
BLOCK = 1 << 16
UNKNOWN = "und"
#: A task forgets the words it knows beyond so many; so many n-grams are counted before they are handed on.
KEPT_WORDS, HELD_WORDS = 400_000, 200_000
_WORD = re.compile(r"[^\W\d_]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def letters(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    return _WORD.findall(text.lower())


def ngrams(words: list[str], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of each word between end marks, and the index of their word. 16 bits hold a character."""
    line = "\x00" + "\x00\x00".join(words) + "\x00"
    chars = np.frombuffer(line.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), lengths + 2)
    chars = np.where(chars > 0xFFFF, (chars ^ (chars >> np.uint64(16)) * np.uint64(40503)) & np.uint64(0xFFFF), chars)
    keys, at = chars, 1
    while at < n and len(keys) > 1:
        keys = (keys[:-1] << np.uint64(16)) | chars[at:]
        at += 1
    # a word shorter than an n-gram with its marks stands as a whole
    whole = owner[: len(keys)] == owner[at - 1 :] if at == n else np.zeros(len(keys), bool)
    short = np.flatnonzero(lengths + 2 < n)
    codes, owners = keys[whole], owner[: len(keys)][whole]
    if len(short):
        extra = [sum(ord(c) % 65521 << 16 * i for i, c in enumerate(words[k])) | 1 << 63 for k in short]
        codes, owners = np.concatenate((codes, np.array(extra, np.uint64))), np.concatenate((owners, short))
    return codes, owners


def positions(codes: np.ndarray, size: int = LEAST_POSITIONS, hashes: int = HASHES) -> np.ndarray:
    """(hashes, len(codes)) positions in the filter."""
    out = np.empty((hashes, len(codes)), np.int64)
    for k in range(hashes):
        h = (codes ^ (codes >> np.uint64(31))) * np.uint64(_MIX[k])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[-1 - k])
        out[k] = (h >> np.uint64(32)) & np.uint64(size - 1)
    return out


class Model:
    """The filter: bits is (planes, positions) of uint64; languages in the order of their bits."""

    def __init__(self, languages: list[str], bits: np.ndarray, hashes: int = HASHES, n: int = NGRAM):
        self.languages, self.bits, self.hashes, self.n = languages, bits, hashes, n
        fill = np.array([np.count_nonzero(bits[i // PLANE] >> np.uint64(i % PLANE) & np.uint64(1)) for i in range(len(languages))]) / max(1, bits.shape[1])
        self.false = fill**hashes
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages) + 1), np.int32)

    def counts(self, words: list[str]) -> np.ndarray:
        """For each word: hits per language, then its n-grams."""
        codes, owner = ngrams(words, self.n)
        at = positions(codes, self.bits.shape[1], self.hashes)
        out = np.zeros((len(words), len(self.languages) + 1), np.int32)
        out[:, -1] = np.bincount(owner, minlength=len(words))
        for p, plane in enumerate(self.bits):
            mask = plane[at[0]]
            for k in range(1, self.hashes):
                mask = mask & plane[at[k]]
            for i in range(p * PLANE, min(len(self.languages), (p + 1) * PLANE)):
                hit = (mask >> np.uint64(i % PLANE) & np.uint64(1)).astype(bool)
                out[:, i] = np.bincount(owner[hit], minlength=len(words))
        return out

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
            self.rows = self.rows[:0]
        if new := list({w for t in texts for w in t if w not in known}):
            base = len(known)
            known.update(zip(new, range(base, base + len(new)), strict=True))
            self.rows = np.concatenate((self.rows, self.counts(new)))
        out = []
        for t in texts:
            if not t or not self.languages or not any(c.isalpha() for w in t for c in w):
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[[known[w] for w in t]].sum(axis=0, dtype=np.int64)
            n = max(1, int(total[-1]))
            share = np.clip((total[:-1] / n - self.false) / np.maximum(1e-9, 1 - self.false), 0, 1)
            best = int(np.argmax(share))
            out.append((self.languages[best], float(share[best])))
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", n: int = NGRAM, size: int | None = None, hashes: int = HASHES, rarer: float = RARER, least: float = LEAST) -> Model:
    """Learn the filter from all rows of docs with a text and a language. What reaches the driver has at most `size` positions a plane, MOST_POSITIONS if not given."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for name, words in held.items():
                codes, owner = ngrams(list(words), n)
                uses = np.fromiter(words.values(), np.int64, len(words))[owner]
                code, at = np.unique(codes, return_inverse=True)
                yield pd.DataFrame({"lang": name, "code": code.view(np.int64), "n": np.bincount(at, uses).astype(np.int64)})
            held.clear()

        for b in batches:
            for t, name in zip(b["text"], b["lang"], strict=True):
                if words := letters(t):
                    held.setdefault(name, Counter()).update(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    grams = keep(rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "li-grams")
    # one row per language, of which there are few: no key of theirs may gather the n-grams of a language in one task
    totals = sorted(map(tuple, grams.groupBy("lang").agg(F.sum("n")).collect()))
    names = [x for x, _ in totals]
    index = grams.sparkSession.createDataFrame([(x, i, n) for i, (x, n) in enumerate(totals)] or [("", 0, 1)], "lang string, bit int, total long")
    share = F.col("n") / F.col("total")
    kept = grams.join(F.broadcast(index), "lang").filter(share >= least).withColumn("_most", F.max(share).over(W.partitionBy("code"))).filter(share >= F.col("_most") * rarer)
    kept = keep(kept.select("code", "bit"), "li-kept")
    if size is None:
        largest = kept.groupBy("bit").count().agg(F.max("count")).first()[0] or 0
        size = min(MOST_POSITIONS, max(LEAST_POSITIONS, 1 << (ROOM * largest - 1).bit_length() if largest else 0))
    masks = kept.groupBy("code", F.floor(F.col("bit") / PLANE).cast("int").alias("plane")).agg(F.bit_or(F.expr(f"shiftleft(1L, bit % {PLANE})")).alias("mask"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = positions(b["code"].to_numpy().view(np.uint64), size, hashes)
            yield pd.DataFrame({"plane": np.tile(b["plane"], hashes), "position": at.ravel(), "mask": np.tile(b["mask"], hashes)})

    placed = masks.mapInPandas(place, "plane int, position long, mask long").groupBy("plane", "position").agg(F.bit_or("mask").alias("mask"))
    width = min(BLOCK, size)

    def block(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width, np.int64)
        out[g["position"].to_numpy() % width] = g["mask"].to_numpy()
        return pd.DataFrame({"plane": [key[0]], "block": [key[1]], "bits": [out.tobytes()]})

    bits = np.zeros((-(-max(1, len(names)) // PLANE), size), np.uint64)
    for row in placed.groupBy("plane", F.floor(F.col("position") / width).alias("block")).applyInPandas(block, "plane int, block long, bits binary").toLocalIterator():
        bits[row["plane"], row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint64)
    return Model(names, bits, hashes, n)


def identify(docs: DataFrame, model: Model, text: str = "text", columns: tuple[str, str] = ("lang_pred", "score"), without: tuple[str, ...] = ()) -> DataFrame:
    """docs, less the columns `without`, with the predicted language and its score: the part of the text's n-grams, corrected, that the language contains.

    A null text, one without a letter, and any text when nothing was learned, are `und` with score 0; ties go to the
    first language by name. Empty tables stay empty; other columns pass through, but for those named as `columns` are,
    whose place the results take.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    gone = {c.lower() for c in columns}
    rest = [f for f in docs.schema.fields if f.name not in without and f.name.lower() not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, got = b.column(text), []
            for at in range(0, len(texts), 128):  # the words of a whole batch would take several times its size
                got += shared.value.predict([letters(t) if t else [] for t in texts.slice(at, 128).to_pylist()])
            columns_ = [b.column(f.name) for f in rest] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns_, names=[*(f.name for f in rest), *columns])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(crc_of_id(doc_id), F.lit(5)) == 0


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, without=("text",))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_language_id": op3_language_id}
