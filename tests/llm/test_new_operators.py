"""Toxicity, the prefix trie and vector codes against brute force, with nulls, empty values, ties, repeated rows and odd columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.llm import language_id, lm, metric_trees, mixing, prefix_trie, toxicity
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("module, name", [(prefix_trie, "op12_prefix_trie"), (metric_trees, "op13_vector_codes")])
def test_same_as_sql(spark, module, name):
    agree(spark, connect(SF), module.QUERIES[name], module.ORACLE[name], SF)


def rebuild(rows):
    """conv_id -> rebuilt turns, by reading the rule."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def brute_trie(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        found = [p]
        for q in found:
            found += kids[q]
        return found

    rows = []
    for p, m in members.items():
        below = under(p)
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, n long, c string"


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    """Few words, so that conversations share long ways; repeated rows, null turns, roles, texts and ids, ids that lack their base, narrow blocks."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 40), 45, 61, 62, 63, 64, 65, 1000003]:
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t, "user" if t % 2 else None, str(rng.choice(["a b", "c", ""])), 0, "x"))
    same = [(c, t, "u", f"long way {t}", 0, "x") for c in (200, 205, 206, 220) for t in range(9)]
    rows += same + [(7, None, "user", None, 0, None), (7, 0, "user", "a b", 0, None), (7, 0, "user", "a b", 0, None), (None, 1, "user", "nobody", 0, None)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), first=2, further=3)
    assert trie_rows(got) == brute_trie(rebuild([r[:4] for r in rows]))


def test_trie_of_copies(spark):
    """A third of all rows in one conversation, most conversations equal, and turnless ones."""
    rows = [(20 * c, t, "u", f"turn {t}", 0, "x") for c in range(60) for t in range(10)] + [(1300, t, "u", f"own {t}", 0, "x") for t in range(300)]
    rows += [(c, 0, "u", "gone", 0, "x") for c in range(2001, 2019)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), first=4, further=4)
    assert trie_rows(got) == brute_trie(rebuild([r[:4] for r in rows]))


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).columns == list(COLUMNS)
    assert prefix_trie.conversation_trie(empty).count() == 0
    alone = prefix_trie.conversation_trie(spark.createDataFrame([(2001, 0, "u", "gone", 0, "x")], SCHEMA))
    assert trie_rows(alone) == brute_trie(rebuild([(2001, 0, "u", "gone")]))


def test_pieces_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.range(0, 500).selectExpr("IF(id < 400, 0, id) AS m", "2L AS depth", "id * 3 AS c")
    got = {r["m"]: r["ends_sha256"] for r in prefix_trie.digests(ends).collect()}
    assert got[0] == hashlib.sha256(",".join(str(3 * i) for i in range(400)).encode()).hexdigest()
    assert got[450] == hashlib.sha256(b"1350").hexdigest()
    assert len(got) == 101


def brute_codes(rows, dim, parts, entries, rounds, scale=1024):
    kept = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == dim]
    ints = [[int(np.floor(float(x) * scale)) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))
    step = -(-dim // parts)
    cut = [[v[p * step : (p + 1) * step] for v in ints] for p in range(parts)]
    books = [[list(cut[p][i]) for i in order[:entries]] for p in range(parts)]

    def near(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(books[p])) for x in cut[p]]

    for _ in range(rounds):
        for p in range(parts):
            at = [e for _, e in near(p)]
            for e in set(at):
                mine = [x for x, z in zip(cut[p], at, strict=True) if z == e]
                books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [near(p) for p in range(parts)]
    error = [sum(f[i][0] for f in found) for i in range(len(kept))]
    by = defaultdict(int)
    for (_, _, k), e in zip(kept, error, strict=True):
        by[k] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((kept[i][0], "".join(f"{f[i][1]:02x}" for f in found), error[i], by[kept[i][2]], sha) for i in range(len(kept))), key=repr)


def code_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("dim", [8, 10, 2])
def test_codes(spark, dim, monkeypatch):
    """Clusters with many equal points and equal entries, nulls, odd values, repeated ids and lengths."""
    monkeypatch.setattr(metric_trees, "CHUNK", 100)
    rng = np.random.default_rng(dim)
    middles = rng.normal(0, 1, (6, dim))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 6] + rng.normal(0, 0.02 * (i % 3), dim)], i % 3 if i % 7 else None) for i in range(400)]
    rows += [(5, rows[5][1], 0), (5, rows[6][1], 1), (None, rows[7][1], 2), (401, None, 1), (402, [None] * dim, 1), (403, [float("nan")] * dim, 1), (404, [float("inf")] * dim, 1), (405, [0.5], 1), (406, [], 1), (407, [-3000.0] * dim, 5)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, n string, error int").repartition(3)
    got = metric_trees.compress(df, entries=16, rounds=3)
    assert code_rows(got) == brute_codes(rows, dim, 4, 16, 3)


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert metric_trees.compress(empty).count() == 0
    one = spark.createDataFrame([(3, [3e38] * 4, None)], "vec_id long, embedding array<float>, label int")
    assert code_rows(metric_trees.compress(one))[0][:4] == (3, "00000000", 0, 0)
    bare = spark.createDataFrame([(3, [], 1), (4, [], 1)], "vec_id long, embedding array<float>, label int")
    assert [r[:4] for r in code_rows(metric_trees.compress(bare))] == [(3, "00000000", 0, 0), (4, "00000000", 0, 0)]


def test_balls_are_owned_whole():
    """Well parted points: most balls go to their entry without a look at their points, and sums are those of brute force."""
    rng = np.random.default_rng(4)
    points = (rng.integers(-9, 9, (3000, 5)) + 1000 * rng.integers(0, 4, (3000, 1))).astype(np.int64)
    tree = metric_trees.build(points)
    assert sorted(tree.order.tolist()) == list(range(3000))
    for i in range(len(tree.first)):
        here = tree.points[tree.first[i] : tree.last[i]]
        assert (tree.total[i] == here.sum(axis=0)).all()
        assert ((here - tree.pivot[i]) ** 2).sum(axis=1).max() <= tree.radius[i] ** 2 * (1 + 1e-9)
    entries = metric_trees.Entries(np.array([[1000 * k] * 5 for k in range(4)] + [[0] * 5]))
    sums, counts = np.zeros((5, 5), np.int64), np.zeros(5, np.int64)
    looked = []
    owned = metric_trees.assign(tree, entries, lambda b, e: looked.append(0), lambda b, near, far, which: looked.append(len(near)))
    assert owned >= 4 and sum(looked) == 0
    metric_trees.added(tree, entries, sums, counts)
    near = ((points[:, None] - entries.values[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert counts.tolist() == np.bincount(near, minlength=5).tolist()
    assert all((sums[e] == points[near == e].sum(axis=0)).all() for e in range(5))


def brute_logit(model, text):
    """The mean over words of the mean over n-grams, one n-gram at a time."""
    found = toxicity.words(text)
    per = []
    for w in found:
        ids, _ = toxicity.buckets([w])
        marked = f"<{w}>"
        assert len(ids) == sum(max(0, len(marked) - n + 1) for n in toxicity.LENGTHS)
        per.append(float(np.mean([model.gains[i] for i in ids])) if len(ids) else 0.0)
    return model.bias + (sum(per) / len(per) if per else 0.0)


def toxic_tables(spark, n=300):
    rng = np.random.default_rng(5)
    clean, bad = ["house", "river", "green", "walks", "over", "the", "stone", "bridge"], ["grumbler", "nastyman", "vilefoe"]
    rows, labels = [], []
    for i in range(n):
        some = list(rng.choice(clean, 40))
        if i % 3 == 0:
            some[int(rng.integers(0, 40))] = str(rng.choice(bad))
        rows.append((i, " ".join(some), "x"))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = spark.createDataFrame([*rows, (n, None, "x"), (n + 1, "", "x"), (n + 2, "  ...  ", None), (n + 3, "the house over the river " * 5000, "x"), (n + 3, "the house over the river " * 5000, "x"), (n + 4, "river " * 20 + "grumblerr", "x"), (None, "q" * 300, None)], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None), (2, 0, 7), (999999, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-brute_logit(model, r["text"] or ""))), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and toxicity.is_held_out(r["doc_id"])]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) >= 0.95
    by = {r["doc_id"]: r for r in got}
    assert by[304]["predicted"] == 1  # a misspelling that no text of the training has
    assert by[303]["predicted"] == 0
    assert by[300]["score"] == by[301]["score"] == by[302]["score"]


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark, 30)
    assert toxicity.score(docs, toxicity.train(docs, labels.filter("false"))).filter("predicted = 1").count() == 0
    model = toxicity.train(docs.filter("false"), labels)
    assert toxicity.score(docs.filter("false"), model).count() == 0


def test_toxicity_held_out(spark):
    """Labels and sources of held-out rows play no part; accuracy on them."""
    out = toxicity.op11_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) >= 0.9
    changed = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(changed, labels.filter(~toxicity.held_out()))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(changed.select("doc_id", "text"), model).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in rows)


def test_lm_keeps_other_columns(spark):
    """Times to the microsecond, maps with numbers as keys, nulls, and columns named like results or helpers."""
    docs = spark.createDataFrame([(1, "a b c", 7, 8, 9), (2, None, None, None, None), (3, "", 1, 2, 3)], "doc_id long, text string, score int, _row int, _rk int")
    docs = docs.withColumn("at", F.when(F.col("doc_id") < 3, F.expr("TIMESTAMP '2024-01-01 00:00:00.123456'"))).withColumn("m", F.create_map(F.col("doc_id").cast("int"), F.lit("x")))
    got = {r["doc_id"]: r for r in lm.score(docs, docs).collect()}
    want = {r["doc_id"]: r for r in docs.collect()}
    assert len(got) == 3
    for k, r in got.items():
        assert all(r[c] == want[k][c] for c in ("_row", "_rk", "at", "m")) and r["score"] < 0 and r["train_tokens"] == 6
    assert got[1].__fields__.count("score") == 1 and "text" not in got[1].__fields__


def test_language_prediction_against_exact_sets(spark):
    """The filter's prediction against exact n-gram sets, counted one n-gram at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 and r["lang"] is not None and r["text"]]
    grams = lambda text: [g for w in re.findall(r"[^\W\d_]+", text.lower()) for m in [f"\0{w}\0"] for g in ([m] if len(m) < 4 else [m[i : i + 4] for i in range(len(m) - 3)])]
    counts = defaultdict(lambda: defaultdict(int))
    for r in train:
        for g in grams(r["text"]):
            counts[r["lang"]][g] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    share = defaultdict(dict)
    for x, c in counts.items():
        for g, n in c.items():
            if n / total[x] >= language_id.LEAST:
                share[g][x] = n / total[x]
    holds = {x: {g for g, s in share.items() if x in s and s[x] >= language_id.RARER * max(s.values())} for x in counts}
    got = {r["doc_id"]: r for r in language_id.op3_language_id(spark, SF).collect()}
    checked = agreed = 0
    for r in rows:
        g = grams(r["text"] or "")
        if not g:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        scores = {x: sum(q in holds[x] for q in g) / len(g) for x in holds}
        best = max(scores.values())
        checked += 1
        agreed += got[r["doc_id"]]["lang_pred"] in {x for x, s in scores.items() if s >= best - 0.02} and abs(got[r["doc_id"]]["score"] - scores[got[r["doc_id"]]["lang_pred"]]) <= 0.05
    assert checked > 100 and agreed == checked


def test_mix_takes_what_the_schedule_says(spark):
    """taken against the van der Corput schedule walked slot by slot: each source's slots, times the block, to a block or two."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.op1_mixing(spark, SF).collect()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        target[s] = r["target"]
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(target, key=lambda s: (s is None, s or ""))
    total, edges, at = sum(size.values()), [], 0.0
    for s in names:
        at += target[s] / sum(target.values())
        edges.append(at)
    m = 14
    slots = defaultdict(int)
    for i in range(1 << m):  # van der Corput points through cumulative shares
        x = sum((i >> b & 1) / (2 << b) for b in range(m))
        slots[names[min(len(names) - 1, next((j for j, e in enumerate(edges) if x < e), len(names) - 1))]] += 1
    for s in names:
        walked = slots[s] / (1 << m) * total
        assert abs(taken[s] - walked) <= 2 * 64 + total * len(names) / (1 << m)
