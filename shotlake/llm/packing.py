"""Packing token pieces into fixed windows by best-fit decreasing.

Documents are tokenised once; a document longer than a window is first cut into full windows, which are sequences of
their own, and a rest. The rests are dealt into groups of bounded size by a hash of the id, and each group is packed on
its own: from the longest rest down, a segment tree indexed by remaining capacity finds the tightest open window.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm.common import keep, table
from shotlake.llm.tokens import tokenizer_path, word_ids

WINDOW = 2048
END_ID = 1
#: A group packed by one task has about so many rests; larger groups waste less, by under a window each.
GROUP_ROWS = 20_000


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree whose leaves count the windows of each capacity."""

    def __init__(self, window: int):
        self.width = 1 << max(1, window).bit_length()
        self.count = [0] * (2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.width + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity of at least `need`: (window, capacity)."""
        node, count = self.width + need, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node <<= 1
                node += not count[node]
        capacity = node - self.width
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For lengths in descending order, each at most `window`: the window and the offset of each."""
    open_, n, where, offset = OpenWindows(window), 0, [], []
    for need in lengths:
        if (found := open_.tightest(need)) is None:
            found, n = (n, window), n + 1
        at, capacity = found
        where.append(at)
        offset.append(window - capacity)
        open_.put(at, capacity - need)
    return where, offset


def pieces(docs: DataFrame, doc_id: str, text: str, window: int, path: str | None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. Each document's ids end with END_ID."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_path(path))
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                ids = memoryview(words.encode(t or "") + end)
                n = len(ids) // 4
                out += [(d, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long").withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows, and rows with a null id, are packed as rows of their own;
    ties in length go by id, then start. Sequence ids are unique, not consecutive. An empty table gives an empty result.
    """
    cut = keep(pieces(docs, doc_id, text, window, path).withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    full = cut.filter(F.col("length") == window)
    rest = cut.filter(F.col("length") < window)
    groups = max(1, math.ceil(rest.count() / group_rows))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32", "_row"], ascending=[False, True, True, True, True], ignore_index=True)
        where, offset = best_fit_decreasing(g["length"].tolist(), window)
        return g.assign(sequence_id=np.array(where, np.int64) * groups + int(key[0]), offset=np.array(offset, np.int64))[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # the row number deals equal rows (say, null ids without text) to all groups
    packed = rest.groupBy(F.pmod(F.xxhash64("doc_id", "ids_crc32", "_row"), F.lit(groups)).alias("_g")).applyInPandas(run, schema)
    # windows that one piece fills have negative ids, distinct by row
    alone = full.withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long")).drop("_row")
    return packed.unionByName(alone)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_packing": op10_packing}
