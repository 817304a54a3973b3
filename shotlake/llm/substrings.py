"""Repeated substrings by suffix order, over texts of any total size.

A string of LENGTH bytes that starts at s is a window. Windows with equal bytes have the same minimiser (the smallest
hash of any GRAM bytes inside), so the text is cut into stretches of windows that share one: about one stretch for 85
windows. Stretches meet by minimiser. Where a minimiser stands once, nothing repeats; where all its stretches are the
same bytes, every window of them repeats. Only minimisers with different stretches need a look at the bytes: each
distinct stretch is fetched once, and the windows of a minimiser are sorted to depth LENGTH, ties by place in the
corpus. Previous and next smaller positions in that order give each window's longest previous factor, which tells the
copies that have an earlier one. Minimisers with more windows than a task should sort are counted by the 128-bit hash of
each window instead. Stretches of one minimiser are taken for equal by a further 64-bit hash.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlake.llm.common import HOT_SHARE, attach, keep, table, text_or_empty

LENGTH, GRAM = 200, 32
#: A stretch has at most so many windows; a text is read in chunks of so many bytes.
STRETCH, CHUNK = 4096, 1 << 22
#: Windows that a task sorts at a time, and windows of one minimiser beyond which they are counted by hash.
SORTED_AT_ONCE, MOST_WINDOWS = 150_000, 100_000


def _splitmix(n: int) -> np.ndarray:
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE = _splitmix(256)
_STEP = _splitmix(300)[256:] | np.uint64(1)


def _sliding(x: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """pick over each `span` neighbours."""
    width = 1
    while 2 * width <= span:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash for the bytes at each place and the gram - 1 after it (gram is a power of two)."""
    h, width, k = _BYTE[b], 1, 0
    while width < gram:
        h = h[:-width] * _STEP[k] + h[width:]
        width, k = 2 * width, k + 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def stretches(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each stretch: first window, number of windows, minimiser, hash of its bytes, and whether the minimiser stands in it twice."""
    out = []
    for at in range(0, len(data) - length + 1, CHUNK):
        h = gram_hashes(np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - at), at), gram)
        span = length - gram + 1
        low = _sliding(h, span, np.minimum)
        first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        n = np.diff(np.append(first, len(low)))
        if (n > STRETCH).any():
            first = np.concatenate([np.arange(a, a + k, STRETCH) for a, k in zip(first, n, strict=True)])
            n = np.diff(np.append(first, len(low)))
        value = low[first]
        # a place is a minimiser if some window around it has its hash as minimum
        padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
        places = np.flatnonzero(_sliding(padded, span, np.maximum) == h)
        lo, hi = np.searchsorted(places, first), np.searchsorted(places, first + n + span - 1)
        owner = np.repeat(np.arange(len(first)), hi - lo)
        inside = places[np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        twice = np.bincount(owner[h[inside] == value[owner]], minlength=len(first)) > 1
        first = first + at
        digest = xxhash.xxh3_64_intdigest
        whole = np.array([digest(data[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)], np.uint64)
        out.append((first.astype(np.int32), n.astype(np.int32), value.view(np.int64), whole.view(np.int64), twice))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.array([], np.int32), np.array([], np.int32), np.array([], np.int64), np.array([], np.int64), np.array([], bool))


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def longest_previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, with their places in the corpus and the letters each has in common with the one before it: the longest factor that starts at an earlier place.

    Of all suffixes at earlier places, the previous and the next smaller position in suffix order share most with a
    suffix. Both are found by jumping: who isn't smaller hands on where it looked, so the jumps double.
    """
    n, best = len(place), np.zeros(len(place), np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        shared = common.copy() if step < 0 else np.append(common[1:], 0)
        open_ = np.flatnonzero((to >= 0) & (to < n))
        while len(open_ := open_[place[to[open_]] > place[open_]]):
            via = to[open_]
            shared_via, to_via = shared[via], to[via]
            shared[open_] = np.minimum(shared[open_], shared_via)
            to[open_] = to_via
            open_ = open_[(to_via >= 0) & (to_via < n)]
        found = (to >= 0) & (to < n)
        best[found] = np.maximum(best[found], shared[found])
    return best


def previous_factors(strings: list[bytes], counts: list[int], order: list[tuple], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For the windows of each string: whether it repeats at all, and whether a copy stands before it.

    counts says how often each string stands in the corpus; order, where it stands first. Windows are sorted by bytes,
    ties by place; a window has an earlier copy if its longest previous factor is as long as itself.
    """
    sizes = np.array([len(s) - length + 1 for s in strings])
    rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(s, np.uint8), length) for s in strings])
    owner, at = np.repeat(np.arange(len(strings)), sizes), np.concatenate([np.arange(n) for n in sizes])
    key = np.array([o[:-1] for o in order], np.int64)
    by_place = np.lexsort((np.array([o[-1] for o in order], np.int64)[owner] + at, *key[owner].T[::-1]))
    place = np.empty(len(owner), np.int64)
    place[by_place] = np.arange(len(owner))
    suffix = by_place[np.argsort(np.ascontiguousarray(rows[by_place]).view(f"S{length}").ravel(), kind="stable")]
    differs = rows[suffix[1:]] != rows[suffix[:-1]]
    common = np.append(0, np.where(differs.any(axis=1), differs.argmax(axis=1), length))
    factor = np.empty(len(owner), np.int64)
    factor[suffix] = longest_previous_factors(place[suffix], common)
    earlier, later = factor >= length, np.zeros(len(owner), bool)
    later[suffix[:-1]] = common[1:] == length
    repeats = earlier | later | (np.array(counts)[owner] > 1)
    ends = np.cumsum(sizes)[:-1]
    return np.split(repeats, ends), np.split(earlier, ends)


_FOUND = "a long, h long, runs array<struct<x:int,y:int>>, later array<struct<x:int,y:int>>"


def _sort_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of repeated windows of each distinct stretch; rows come sorted by minimiser."""
    held, rest = 0, []

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        repeats, earlier = previous_factors(rows["data"].tolist(), rows["n"].tolist(), list(zip(rows["k1"], rows["k2"], rows["s"], strict=True)))
        return pd.DataFrame({"a": rows["a"], "h": rows["h"], "runs": [_runs(r) for r in repeats], "later": [_runs(r) for r in earlier]})

    for b in batches:
        rest.append(b)
        held += int(b["c"].sum())
        if held >= SORTED_AT_ONCE:
            rows = pd.concat(rest, ignore_index=True)
            last = int(np.searchsorted((rows["a"] == rows["a"].iloc[-1]).to_numpy(), True))
            at, done = 0, np.cumsum(rows["c"].to_numpy())
            new = np.append(np.flatnonzero(np.append(True, rows["a"].to_numpy()[1:] != rows["a"].to_numpy()[:-1])), len(rows))
            while at < last:  # whole minimisers, about SORTED_AT_ONCE windows
                stop = int(np.searchsorted(done, (done[at - 1] if at else 0) + SORTED_AT_ONCE))
                stop = min(last, int(new[np.searchsorted(new, stop, "right") - 1]) if new[np.searchsorted(new, stop, "right") - 1] > at else int(new[np.searchsorted(new, at, "right")]))
                yield solve(rows.iloc[at:stop])
                at = stop
            rest = [rows.iloc[last:]]
            held = int(rest[0]["c"].sum())
    if rest and sum(map(len, rest)):
        yield solve(pd.concat(rest, ignore_index=True))


def _window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for row in b.itertuples():
            got = [xxhash.xxh3_128_digest(row.data[i : i + LENGTH]) for i in range(row.c)]
            w = np.frombuffer(b"".join(got), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"w1": w[:, 0], "w2": w[:, 1], "a": row.a, "h": row.h, "n": row.n, "k1": row.k1, "k2": row.k2, "s": row.s, "i": np.arange(row.c, dtype=np.int32)})


def _runs_of(windows: DataFrame, name: str) -> DataFrame:
    """(a, h, name): runs of window numbers i that follow each other, of each stretch."""
    order = W.partitionBy("a", "h").orderBy("i")
    runs = windows.withColumn("_g", F.col("i") - F.row_number().over(order)).groupBy("a", "h", "_g").agg(F.min("i").alias("x"), F.max("i").alias("y"))
    return runs.groupBy("a", "h").agg(F.collect_list(F.struct("x", "y")).alias(name))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with k1, the place of the document by id, and k2, the hash of its text: the same for rows that are equal in both."""
    whole = docs.schema[doc_id].dataType
    key = F.col(doc_id).cast("long") if isinstance(whole, (T.IntegralType,)) else F.xxhash64(doc_id)
    return docs.withColumn("_t", text_or_empty(text)).withColumn("k1", F.coalesce(key, F.lit(-(1 << 63)))).withColumn("k2", F.xxhash64("_t"))


def _squeezed(keyed: DataFrame, more: list[str]) -> DataFrame:
    """(k1, k2, z, more): texts compressed, for what must be moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(1)
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in ("k1", "k2", *more)}, "z": [pack.compress(t.encode("utf-8", "surrogatepass")) for t in b["_t"]]})

    fields = [keyed.schema[c] for c in ("k1", "k2", *more)]
    return keyed.select("k1", "k2", *more, "_t").mapInPandas(run, T.StructType([*fields, T.StructField("z", T.BinaryType())]))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: bool = False) -> DataFrame:
    """(k1, k2, spans): byte spans [x, y) of each text, unmerged, whose windows repeat; with `first`, only of those with an earlier copy."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [stretches(t.encode("utf-8", "surrogatepass")) for t in b["_t"]]
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], **{n: [g[i] for g in got] for i, n in enumerate("scahm")}})

    keyed = _keyed(docs, doc_id, text)
    all_ = keep(keyed.select("k1", "k2", "_t").filter(F.octet_length("_t") >= LENGTH).mapInPandas(cut, "k1 long, k2 long, s array<int>, c array<int>, a array<long>, h array<long>, m array<boolean>"), "ss-stretches")
    all_ = all_.withColumn("_row", F.monotonically_increasing_id())
    one = all_.select("k1", "k2", "_row", F.explode(F.arrays_zip("s", "c", "a", "h", "m")).alias("r")).select("k1", "k2", "_row", "r.*")
    # minimisers that stand often, known from a sixteenth of all stretches (drawn one by one, so copies of a text don't go together), are counted before they move; the others move once
    some = one.filter(F.pmod(F.xxhash64("_row", "s"), F.lit(16)) == 0)
    one = one.drop("_row")
    total = some.count()
    hot = keep(some.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > max(8.0, total * HOT_SHARE / 2)).select("a"), "ss-hot")
    facts = [F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("m").alias("any"), F.min(F.struct("k1", "k2", "s")).alias("at")]
    seen = keep(one.join(F.broadcast(hot), "a").groupBy("a").agg(*facts), "ss-facts")
    w = W.partitionBy("a")
    cold = one.join(F.broadcast(hot), "a", "left_anti")
    cold = cold.select("*", F.count("*").over(w).alias("n"), F.min("h").over(w).alias("lo"), F.max("h").over(w).alias("hi"), F.max("m").over(w).alias("any"), F.min(F.struct("k1", "k2", "s")).over(w).alias("at"))
    both = cold.unionByName(one.join(F.broadcast(seen), "a").select(cold.columns))
    mixed = (F.col("lo") != F.col("hi")) | F.col("any")
    found = keep(both.filter((F.col("n") > 1) | F.col("any")).select("k1", "k2", "s", "c", "a", "h", mixed.alias("mixed"), (F.struct("k1", "k2", "s") == F.col("at")).alias("is_first")), "ss-shared")

    # distinct stretches of minimisers with several: fetch the bytes of each from one text
    kinds = found.filter("mixed").groupBy("a", "h").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "s")).alias("p"), F.first("c").alias("c"))
    kinds = keep(kinds.select("a", "h", "n", "p.*", "c"), "ss-kinds")
    sizes = keep(kinds.groupBy("a").agg(F.count("*").alias("rows"), F.sum("c").alias("windows")), "ss-sizes")
    kinds = attach(kinds, sizes, ["a"], ["h"], count="rows").withColumn("many", F.col("windows") > MOST_WINDOWS)
    wanted = kinds.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "h", "n", "s", "c", "many")).alias("want"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k1, k2, z, want in zip(b["k1"], b["k2"], b["z"], b["want"], strict=True):
                data = unpack.decompress(z)
                out += [(r["a"], r["h"], r["n"], k1, k2, r["s"], r["c"], r["many"], data[r["s"] : r["s"] + r["c"] + LENGTH - 1]) for r in want]
            yield pd.DataFrame(out, columns=["a", "h", "n", "k1", "k2", "s", "c", "many", "data"])

    texts = _squeezed(keyed.filter(F.octet_length("_t") >= LENGTH), []).join(wanted, ["k1", "k2"])
    bytes_ = keep(texts.mapInPandas(fetch, "a long, h long, n long, k1 long, k2 long, s int, c int, many boolean, data binary"), "ss-bytes")
    few = bytes_.filter("not many").repartition("a").sortWithinPartitions("a", "h", "k1", "k2", "s").mapInPandas(_once(_sort_stretches), _FOUND)
    hashed = bytes_.filter("many").mapInPandas(_window_hashes, "w1 long, w2 long, a long, h long, n long, k1 long, k2 long, s int, i int")
    groups = keep(hashed.groupBy("w1", "w2").agg(F.count("*").alias("rows"), F.sum("n").alias("copies"), F.min(F.struct("k1", "k2", F.col("s") + F.col("i"))).alias("at")), "ss-windows")
    marked = attach(hashed, groups, ["w1", "w2"], ["a", "h", "i"], count="rows")
    marked = keep(marked.filter("copies > 1"), "ss-marked")
    many = _runs_of(marked, "runs").join(_runs_of(marked.filter(F.struct("k1", "k2", F.col("s") + F.col("i")) != F.col("at")), "later"), ["a", "h"], "left")
    many = many.withColumn("later", F.coalesce("later", F.expr("cast(array() as array<struct<x:int,y:int>>)")))
    runs = keep(few.unionByName(many), "ss-runs")
    runs = keep(kinds.select("a", "h", "n", F.struct("k1", "k2", "s").alias("at")).join(runs, ["a", "h"]), "ss-runs-at")

    solid = found.filter("not mixed" + (" and not is_first" if first else "")).select("k1", "k2", F.col("s").alias("x"), (F.col("s") + F.col("c") + LENGTH - 1).alias("y"))
    parts = attach(found.filter("mixed").select("k1", "k2", "s", "a", "h"), runs, ["a", "h"], ["k1", "s"])
    took = F.when(F.struct("k1", "k2", "s") == F.col("at"), F.col("later")).otherwise(F.col("runs")) if first else F.col("runs")
    parts = parts.select("k1", "k2", "s", F.explode(took).alias("r")).select("k1", "k2", (F.col("s") + F.col("r.x")).alias("x"), (F.col("s") + F.col("r.y") + LENGTH).alias("y"))
    return solid.unionByName(parts).groupBy("k1", "k2").agg(F.collect_list(F.struct("x", "y")).alias("spans"))


def _once(solve):
    """solve for rows that may repeat: a stretch fetched from repeated rows counts once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def single() -> Iterator[pd.DataFrame]:
            last = None
            for b in batches:
                key = b[["a", "h"]].to_numpy()
                fresh = np.append(True, (key[1:] != key[:-1]).any(axis=1)) if len(b) else np.array([], bool)
                if len(b) and last is not None and (key[0] == last).all():
                    fresh[0] = False
                last = key[-1] if len(b) else last
                yield b[fresh]

        yield from solve(single())

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; runs that touch are one."""
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Removes every byte that a repeated window of LENGTH bytes covers; with `first`, the first copy of each window (by
    id, then place) does not count. Null texts are empty; texts shorter than a window stay whole; repeated rows are
    copies of each other; an empty table gives an empty result. Other columns play no part.
    """
    keyed = _keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    spans = repeated(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), first=first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for d, z, got in zip(b["doc_id"], b["z"], b["spans"], strict=True):
                data = unpack.decompress(z)
                cut = merged([(r["x"], r["y"]) for r in got]) if got is not None else []
                kept, at = hashlib.sha256(), 0
                for x, y in cut:
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                out.append((d, len(data), sum(y - x for x, y in cut), len(cut), kept.hexdigest(), [list(c) for c in cut]))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema[doc_id].dataType
    texts = _squeezed(keyed.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("row", F.monotonically_increasing_id()), ["doc_id", "row"])
    # rows that are equal in id and text are as many as they like: their spans are broadcast where they are hot
    rows = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    spans = keep(spans.join(rows, ["k1", "k2"]), "ss-spans")
    out = attach(texts, spans, ["k1", "k2"], ["row"]).mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


ORACLE: dict[str, str] = {}
QUERIES = {"op6_substrings": op6_substrings}
