"""The text operators against brute force on small tables, with nulls, empty texts, ties, repeated rows and odd columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shotlake.llm import ann, common, exact_dedup, language_id, lm, mixing, packing, pii, simhash, substrings, tokens, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ré", "tu", "sen"], rng.integers(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, and columns with clashing names."""
    base = prose(1, 400)
    rows = [(1, base, "xx", "a"), (2, base, "xx", "a"), (3, base + " end", "xx", "b"), (4, None, None, None), (5, "", "yy", "b"), (6, "x", "yy", "a"), (6, "x", "yy", "a"), (None, prose(2, 60), "yy", "c"), (None, prose(2, 60), None, "c"), (7, "zz " * 6000, "yy", None), (8, prose(3, 3000), "xx", "a"), (9, "123 !!", "yy", "b")]
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, n long, _one int").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_exact_duplicates(odd, docs):
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        groups = defaultdict(list)
        for d, t in rows:
            groups[t].append(d)
        want = [(d, max(groups[t], key=lambda x: -1 if x is None else x), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
        got = exact_dedup.exact_duplicates(df, block=64)
        assert plain(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
        assert got.filter("kept").count() == len(groups)
    assert exact_dedup.exact_duplicates(odd.filter("doc_id = 99")).count() == 0


def brute_print(text: str, k: int) -> int:
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_near_duplicates(odd, docs):
    for df in (odd, docs):
        rows = [(r["doc_id"], brute_print(r["text"] or "", 4)) for r in df.select("doc_id", "text").collect()]
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                    root[find(i)] = find(j)
        least = defaultdict(list)
        for i, (d, _) in enumerate(rows):
            least[find(i)].append(d)
        name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
        assert plain(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == sorted(((d, f"{f:016x}", name[find(i)]) for i, (d, f) in enumerate(rows)), key=repr)
    assert simhash.near_duplicates(odd.filter("doc_id = 99")).count() == 0


def test_anchors_cover_one_bit(spark):
    rng = np.random.default_rng(0)
    fps = rng.integers(-(1 << 63), 1 << 63, 50, dtype=np.int64).tolist()
    rows = [(i, f, f ^ (1 << int(b)) if b < 63 else f ^ -(1 << 63)) for i, f in enumerate(fps) for b in rng.integers(0, 64, 4)]
    df = spark.createDataFrame([(i, x, y) for i, x, y in rows], "i long, x long, y long")
    for band, (low, bits) in enumerate(simhash.BANDS):
        mask = ((1 << bits) - 1) << low
        got = df.select("x", "y", simhash._anchors(F.col("x"), band)[0]["key"].alias("home"), F.transform(simhash._anchors(F.col("y"), band), lambda a: a["key"]).alias("all")).collect()
        assert all(r["home"] in r["all"] for r in got if ((r["x"] ^ r["y"]) & mask & (2**64 - 1)).bit_count() <= 1)


def test_links_of_dense_groups_and_grids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 8)
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    rng = np.random.default_rng(1)
    center = int(rng.integers(0, 1 << 62))
    fps = sorted({center ^ sum(1 << int(b) for b in rng.integers(0, 60, rng.integers(0, 6))) for _ in range(150)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    brute = dict(root)
    for e in edges:
        assert (e["u"] in root) and (e["v"] in root)
        root[find(e["u"])] = find(e["v"])
    got = defaultdict(set)
    for f in fps:
        got[find(f)].add(f)
    root = brute
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                root[find(x)] = find(y)
    want = defaultdict(set)
    for f in fps:
        want[find(f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201)]
    df = spark.createDataFrame(edges, "u long, v long")
    roots = {r["node"]: r["root"] for r in common.components(df).collect()}
    assert len({roots[i] for i in range(41)}) == 1 and len({roots[i] for i in range(100, 160)}) == 1 and len(set(roots.values())) == 3


def test_mix_comes_near_targets(odd, docs):
    for df in (odd, docs):
        rows = mixing.mix(df).toPandas()
        again = mixing.mix(df).toPandas()
        assert plain_frame(rows) == plain_frame(again)
        sizes = sorted(len(WORD.findall(r["text"] or "")) for r in df.select("text").collect())
        assert sorted(rows["size"]) == sizes
        per = rows.groupby(rows["source"].fillna("~")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
        assert abs(per["target"].sum() - sum(sizes)) < 1e-6
        assert (per["target"] <= 3 * per["size"] + 1e-9).all()
        assert (abs(per["taken"] - per["target"]) <= 3 * mixing.BLOCK_WORDS).all()
        assert (rows["taken"] <= 3 * rows["size"]).all()
    assert mixing.mix(odd.filter("doc_id = 99")).count() == 0


def plain_frame(df):
    return sorted(map(repr, df.itertuples(index=False)))


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weight, target, full = dict(zip(sizes, (5, 2, 1, 5))), {}, {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        open_ = [s for s in sizes if s not in full]
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s: 3.0 * sizes[s] for s in open_ if target[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    assert got == pytest.approx(full | target)


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 65, 300).tolist(), reverse=True)
    where, offset = packing.best_fit_decreasing(lengths, 64)
    room, at = [], []
    for n in lengths:  # the same by looking at every window
        fits = [w for w in range(len(room)) if room[w] >= n]
        if fits:
            w = min(fits, key=lambda w: room[w])
        else:
            w = len(room)
            room.append(64)
        at.append(64 - room[w])
        room[w] -= n
    used = defaultdict(int)
    for w, o, n in zip(where, offset, lengths):
        assert used[w] == o
        used[w] += n
    assert max(used.values()) <= 64 and len(used) == len(room) and sorted(used.values()) == sorted(64 - r for r in room)


def test_packing(odd, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    for df in (odd, docs.filter("doc_id < 60")):
        got = packing.pack(df).toPandas()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            for s in range(0, len(ids), 2048):
                want[(r["doc_id"], s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
        assert Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()) == want
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()] and g["length"].sum() <= 2048
    assert packing.pack(odd.filter("doc_id = 99")).count() == 0


@pytest.mark.parametrize("text", ["it's a DON'T we'll '", "a b", "é Áb", "İ ſ KK", "<|endoftext|> x <|ENDOFTEXT|>", "½ ² x²", "İ. क़! b়?", "中文 ok", "नमस्", "a\U0001f600b", "", "  ", "a\x1cb", "x​b", "1234 a1b2", "a\x00b", "the, the! the?"])
def test_word_ids_are_the_tokenizers(text):
    w = tokens.WordIds(tokens.tokenizer_path())
    assert w.encode(text) == w._whole(text)


def test_letters_with_marks_behind_are_the_tokenizers():
    w = tokens.WordIds(tokens.tokenizer_path())
    every = [chr(c) + "." for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    whole = w.tokenizer.encode_batch_fast(every, add_special_tokens=False)
    assert [t for t, e in zip(every, whole, strict=True) if w.encode(t) != np.array(e.ids, "<u4").tobytes()] == []


def test_word_ids_forget():
    w = tokens.WordIds(tokens.tokenizer_path(), kept=5)
    for t in ("a b c d", "e f g h a", "one two three four five six seven eight"):
        assert w.encode(t) == w._whole(t)


def test_archives_round_trip(spark):
    rows = [(1, "http://a.b/x?z=1&a=2", "h"), (2, "http://www.a.b/", "h"), (3, None, None), (4, "", ""), (None, "u\r\nv", "h"), (7, "http://[bad", "\r\n\r\nWARC/1.1\r\n\x00é"), (8, "x", ""), (9, "http://a.b/", "other")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")
    got = warc.archive_and_index(pages).toPandas()
    by = {None if math.isnan(r.page_id) else int(r.page_id): r for r in got.itertuples()}
    first = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        h = (h or "").encode()
        r = by[p]
        assert (r.payload_bytes, r.payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (r.record_type, None if math.isnan(r.refers_to) else r.refers_to) == (("revisit", first[h]) if h in first else ("response", None))
        first.setdefault(h, p)
    order = got.sort_values(["range", "position"])
    assert order["url_key"].tolist() == sorted(got["url_key"])
    assert warc.archive_and_index(pages.filter("n = 2")).count() == 0


def test_archives_of_large_ids_and_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILES", ((100, 3), (1000, 2), (1 << 62, 1)))
    rows = [(2**62 + i, "u", "p" * (i * 40)) for i in range(60)] + [(-(2**62), "u", "q" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{common.shared_dir(spark)}/large-archives"
    got = warc.archive_and_index(pages, path=path).toPandas()
    assert sorted(zip(got["page_id"], got["payload_bytes"])) == sorted((p, len(h)) for p, _, h in rows)
    sizes = sorted(r[0] for r in spark.read.format("binaryFile").load(path).select("length").collect())
    assert sizes[-2] < 4000 < sizes[-1]


def test_loser_tree_merges():
    rng = np.random.default_rng(3)
    for k in range(9):
        runs = [sorted((int(x), i) for x in rng.integers(0, 50, rng.integers(0, 20))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_ranges_split_one_url(spark):
    runs = spark.createDataFrame([(f"r{k}", "k", f"{i:04d}", str(i), "u", "response", 1, "d", None, i, i // 3) for k in range(3) for i in range(k, 300, 3)], f"{warc.RUN_SCHEMA}, nth long").coalesce(1)
    got = warc.merge_runs(runs, 50, 5).toPandas().sort_values(["range", "position"])
    assert got["captured"].tolist() == sorted(got["captured"]) and got["range"].nunique() > 1
    assert got["capture"].tolist() == got["position"].tolist() and got.groupby("range").size().max() < 120


def test_languages(spark, odd, docs):
    model = language_id.train(docs.filter(~language_id.held_out()))
    got = language_id.identify(docs.withColumn("held", language_id.held_out()), model).filter("held").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.95 and got["score"].between(0, 1).all()
    rows = {(r["doc_id"], r["text"]): r for r in language_id.identify(odd, model).collect()}
    assert rows[(4, None)]["lang_pred"] == rows[(5, "")]["lang_pred"] == rows[(9, "123 !!")]["lang_pred"] == "und"
    mixed = spark.createDataFrame([(1, "m² x²", "own"), (2, "½a", "own"), (3, "½ ²", "own")], "doc_id long, text string, lang_pred string")
    assert [r["lang_pred"] == "und" for r in language_id.identify(mixed, model).orderBy("doc_id").collect()] == [False, False, True]
    none = language_id.train(docs.filter("doc_id < 0"))
    assert none.languages == [] and language_id.identify(odd, none).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(odd.filter("doc_id = 99"), model).count() == 0


def test_filter_holds_what_was_put_in():
    codes, owner = language_id.ngrams(["abcd", "a", "été", "\U0001f600x"])
    assert len(codes) == len(owner) and set(owner) == {0, 1, 2, 3}
    bits = np.zeros((1, 1 << 12), np.uint64)
    for row in language_id.positions(codes, 1 << 12):
        bits[0, row] |= np.uint64(1)
    assert (language_id.Model(["l"], bits).counts(["abcd", "a", "été", "\U0001f600x"])[:, 0] == np.bincount(owner)).all()


def test_many_languages(spark):
    rows = [(i, prose(i, 50).replace("k", chr(0x4E00 + i)), f"l{i:03d}") for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.train(df)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 120


def brute_spans(t: str) -> dict:
    out = {}
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        out[kind] = []
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out[kind].append(m.span())
    return out


def test_base_spans():
    rng = np.random.default_rng(4)
    for _ in range(5000):
        t = "".join(rng.choice(list("a1@.+ -(9@.0%é"), rng.integers(1, 24)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("9" * 200_000 + "." * 10 + "a" * 200_000)["ip"] == []


def test_personal_data(odd, docs):
    for df in (odd, docs):
        got = {(r["doc_id"], r["base_sha256"]) for r in pii.find(df).collect()}
        for r in df.select("doc_id", "text").collect():
            spans = brute_spans(r["text"] or "")
            said = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k])
            assert (r["doc_id"], hashlib.sha256(said.encode()).hexdigest()) in got
    assert pii.find(odd.filter("doc_id = 99")).count() == 0


def test_proposals_are_decided(spark):
    """Planted truth among decoys: proposals are accepted and turned down, with precision and recall."""
    rng, rows, truth, decoys = np.random.default_rng(8), [], {}, {}

    def digits(n, check=None):
        while True:
            d = "4" + "".join(map(str, rng.integers(0, 10, n - 1)))
            if check is None or pii.luhn(d) == check:
                return d

    for i in range(600):
        fill, hexa = prose(i, 8), "".join(rng.choice(list("0123456789abcdef"), 40))
        said = {
            0: (f'api token = "{hexa}"', "secret", hexa), 1: (f"card {digits(16, True)} and mail me.{i}@mail1.example.com", None, None), 2: (f"write to ann.{i} [at] mail1.example [dot] com", "email", None),
            3: (f"phone (212) 555-{i:04d} today, tel +1 (212) 555-{i:04d}", "phone", f"(212) 555-{i:04d}"), 4: (f"order {digits(16, False)} sent", False, None), 5: (f"commit {hexa} fixed", False, hexa),
            6: (f"server 10.1.{i % 250}.7 and 10[.]1[.]{i % 250}[.]9 up", "ip", None), 7: (f"version 1.20.{300 + i}.4 out", False, None), 8: (f"see user{i}@host now", False, None), 9: (fill, False, None),
        }[i % 10]
        text = f"{fill} {said[0]} {fill}"
        rows.append((i, text))
        (truth if said[1] else decoys if said[1] is False else {})[i] = said[1]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(f"{kind}:" in got[i]["spans"] and got[i]["n_added"] > 0 for i, kind in truth.items())
    wrong = sum(got[i]["n_added"] > 0 for i in decoys)
    assert hit >= 0.9 * len(truth) and wrong <= 0.05 * hit


def test_secrets_of_the_documents_are_found(docs):
    token = re.compile(r'token = "([0-9a-f]{40})"')
    for r in pii.find(docs).join(docs, "doc_id").collect():
        assert {f"secret:{m.start(1)}:{m.end(1)}" for m in token.finditer(r["text"])} <= set(r["spans"].split(","))
        assert r["n_spans"] - r["n_added"] == sum(r[f"n_{k}"] for k in pii.KINDS) and r["n_added"] >= len(token.findall(r["text"]))


def test_reliabilities_rank_labelers():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < acc, np.where(truth, 1, 2), np.where(truth, 2, 1)) for acc in (0.95, 0.9, 0.6)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, given, _ = pii.reliabilities(patterns, n.astype(float), np.ones((2, 3, 3)))
    assert abs(prior - 0.4) < 0.06 and given[1, 0, 1] > given[1, 1, 1] > given[1, 2, 1]


def brute_repeats(rows, first=False):
    seen = defaultdict(list)
    data = [(d, (t or "").encode()) for d, t in rows]
    for j, (d, b) in enumerate(data):
        for i in range(len(b) - 199):
            seen[b[i : i + 200]].append((-1 if d is None else d, j, i))
    gone = [np.zeros(len(b), bool) for _, b in data]
    for v in seen.values():
        for _, j, i in (sorted(v)[1:] if first else v) if len(v) > 1 else ():
            gone[j][i : i + 200] = True
    return sorted(((d, len(b), int(g.sum()), len(substrings._runs(g)), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for (d, b), g in zip(data, gone)), key=repr)


@pytest.mark.parametrize("many", [False, True])
def test_repeated_substrings(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(substrings, "MOST_WINDOWS", 50)
    base = prose(9, 700)
    rows = [(1, base[:700]), (2, base[300:900] + "x" * 650), (3, None), (4, ""), (5, "ab" * 400), (6, "x" * 900), (None, base[100:600]), (None, base[100:600]), (7, base[100:600]), (8, base[1000:1250] * 3), (9, base[1000:1199] + "q"), (10, base[50:249] + "é" + base[249:460]), (2, base[300:900]), (11, "y" * 5000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert plain(substrings.remove_repeats(df), *cols) == brute_repeats(rows)
    assert substrings.remove_repeats(df.filter("n = 1")).count() == 0
    if not many:
        unique = [r for r in rows if r[0] is not None and r != (2, base[300:900])]
        assert plain(substrings.remove_repeats(spark.createDataFrame(unique, "doc_id long, text string"), first=True), *cols) == brute_repeats(unique, True)


def test_longest_previous_factors():
    rng = np.random.default_rng(10)
    for letters, n in ((2, 60), (3, 80), (1, 20)):
        text = "".join(rng.choice(list("abc"[:letters]), n))
        order = np.array(sorted(range(n), key=lambda i: text[i:]))
        same = lambda x, y: next((k for k in range(n - max(x, y)) if text[x + k] != text[y + k]), n - max(x, y))
        common = np.array([0, *(same(x, y) for x, y in zip(order[1:], order[:-1]))])
        want = [max((same(i, j) for j in range(i)), default=0) for i in order]
        assert substrings.longest_previous_factors(order, common).tolist() == want


def test_many_copies_of_one_text(spark, monkeypatch):
    """A third of all rows is one text: its stretches are hot, and nothing is lost."""
    base = prose(11, 300)
    rows = [(i if i % 2 else None, base) for i in range(400)] + [(1000 + i, prose(100 + i, 60)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(df).toPandas()
    same = got[got["n_bytes"] == len(base.encode())]
    assert len(got) == 1200 and len(same) == 400 and (same["n_removed"] == same["n_bytes"]).all() and got["n_removed"].sum() == same["n_bytes"].sum()


def test_language_model(odd, docs):
    train = docs.filter(~lm.held_out())
    got = lm.score(docs.select("doc_id", lm.held_out().alias("held_out"), "text"), train).toPandas().set_index("doc_id")
    counts, words = Counter(), {}
    for r in docs.collect():
        words[r["doc_id"]] = re.findall(rb"[^\x20\x09-\x0d]+", r["text"].encode().lower()) + [None]
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update(words[r["doc_id"]])
    n, v = sum(counts.values()), len(counts)
    for d, w in words.items():
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs=1e-8)
    assert (got["score"] < 0).all()
    some = lm.score(odd.select("doc_id", "text"), train).toPandas()
    assert len(some) == odd.count() and np.isfinite(some["score"]).all()
    assert lm.score(odd.select("doc_id", "text"), train.filter("doc_id < 0")).agg(F.sum("n_known")).first()[0] == 0


def layer(seed=6, classes=12):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(lm.END)[:200]
    text = np.array([ids[(7 * i) % 40] for i in range(4000)] + [lm.END], np.int32)
    counts = np.bincount(text, minlength=lm.END + 1).astype(float)
    v = lm.Vocabulary(counts, counts, np.ones(lm.END + 1), classes)
    inputs, targets, _ = lm.cut(np.append(lm.END, text[:-1]), text, np.array([len(text)]), lm.OLD, lm.NEW)
    return v, inputs, targets


def test_windows_score_each_id_once():
    lengths = np.array([1, 30, 12, 13])
    ids = np.arange(lengths.sum())
    inputs, targets, of = lm.cut(ids + 1000, ids, lengths, lm.OLD, lm.NEW)
    assert sorted(targets[targets != lm._PAD]) == ids.tolist() and (np.diff(of) >= 0).all()
    for row, wanted, k in zip(inputs, targets, of):
        first = lengths[:k].sum()
        for j, t in enumerate(wanted):
            if t != lm._PAD:
                seen = [x - 1000 for x in row[: lm.OLD + j + 1] if x != lm._PAD]
                assert seen == list(range(max(first, t - lm.OLD - j), t + 1))


def test_attention_gradients_scores_and_learning():
    v, inputs, targets = layer()
    total = np.bincount(v.cls[: lm.END + 1], v.share[: lm.END + 1])
    assert np.allclose(total[total > 0], 1)
    bias = np.random.default_rng(0).normal(size=(lm.ROWS, 12)).astype(np.float32)
    net = lm.Attention(v, lm.OLD, lm.NEW, bias)
    rows, cls, weight = v.row[inputs], v.cls[targets], (targets != lm._PAD).astype(np.float32)
    net.w = [t.astype(np.float64) for t in net.w]
    some = slice(0, 5)
    loss, grads = net.gradients(rows[some], cls[some], weight[some])
    for t, g in zip(net.w[1:], grads[1:], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        t[at] += 1e-4
        more = net.gradients(rows[some], cls[some], weight[some])[0]
        t[at] -= 1e-4
        assert (more - loss) / 1e-4 == pytest.approx(g[at], rel=2e-2)
    net.w = [t.astype(np.float32) for t in net.w]
    slow = 0.0  # one position at a time
    x_, wq, wk, wv, far, m, wr, b = net.w
    x = x_[rows]
    for i in range(3):
        for j in range(lm.NEW):
            keys = [k for k in range(lm.OLD + j + 1) if rows[i, k] != v.pad]
            s = np.array([x[i, lm.OLD + j] @ wq @ (x[i, k] @ wk) * lm.WIDTH**-0.5 + far[lm.OLD + j - k] for k in keys])
            a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            z = sum(p * (x[i, k] @ wv) for p, k in zip(a, keys)) @ m + x[i, lm.OLD + j] @ wr + b + bias[rows[i, lm.OLD + j]]
            slow += (z[cls[i, j]] - z.max() - np.log(np.exp(z - z.max()).sum())) / math.log(10)
    before = lm.Scorer(net).score(inputs, targets)
    assert before[:3].sum() == pytest.approx(slow, rel=1e-3)
    trainer = lm.Trainer(net)
    for _ in range(30):
        trainer.add(inputs, targets, np.ones(1))
        trainer.run()
    assert lm.Scorer(net).score(inputs, targets).sum() > 0.7 * before.sum()


def test_a_word_goes_on_with_probability_one():
    """All ways on from a first id, remembered or not, add up to one (ids inside are limited to three, words to four ids)."""
    few = np.array([300, 301, 302, lm.END])
    counts = np.bincount(few, [5, 3, 2, 9], lm.END + 1)
    v = lm.Vocabulary(counts, counts, np.bincount(few, minlength=lm.END + 1).astype(float), 10)
    bias = np.full((lm.ROWS, 10), -1e9, np.float32)
    bias[:, v.cls[few]] = np.random.default_rng(1).normal(size=(lm.ROWS, 4))
    scorer = lm.Scorer(lm.Attention(v, lm.OLD_INSIDE, lm.NEW_INSIDE, bias))
    pairs = lm.pd.DataFrame({"a": [300, 300, 301], "b": [301, lm.END, 300], "n": [4, 3, 2]})
    firsts = np.zeros((3, lm.END + 1))
    firsts[:, 300] = (20, 4, 12)
    model = lm.Model(scorer, scorer, pairs, firsts, {b"x": 7, b"y": 5})
    words = [[300]]
    for _ in range(9):
        words += [w + [t] for w in words if len(w) == max(map(len, words)) for t in few[:3]]
    names = [b"x" if w == [300] else b"y" if w == [300, 301] else f"w{k}".encode() for k, w in enumerate(words)]
    got = 10 ** model.goes_on(names, np.concatenate(words).astype(np.int32), np.array([len(w) for w in words]))
    assert 0.97 < got.sum() <= 1 + 1e-6 and got[0] > 7 / 25


def test_model_beats_counting_words_on_held_out_texts(spark):
    """With enough text (at sf0.01, where a sixth of held-out words is new, counting words is ahead: to the base all new words are one)."""
    got = lm.op7_lm(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] > -5 * got[2]


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, [1.0] * 5), (None, [1.0] * 16), (3, x[3].tolist()), (700, x[5].tolist())]
    v = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    assert v.count() == 601
    got = ann.neighbours(v, v.filter("vec_id % 20 = 0")).toPandas()
    ids = [*range(600), 700]
    full = {**dict(enumerate(x)), 700: x[5]}
    m = np.array([full[i] for i in ids])
    hit = 0
    for q, g in got.groupby("query_id"):
        s = (m * full[q]).sum(axis=1)
        best = sorted((-c, i) for c, i in zip(s, ids) if i != q)[:20]
        hit += len({i for _, i in best} & set(g["vec_id"]))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and list(zip(-g["score"], g["vec_id"])) == sorted(zip(-g["score"], g["vec_id"]))
    assert hit >= 0.9 * 20 * got["query_id"].nunique()
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1500)] + [(i, [float(i % 7), 1.0]) for i in range(1500, 2000)], "vec_id long, v array<double>")
    tied = ann.neighbours(same, same.filter("vec_id % 20 = 0")).toPandas()
    assert len(tied) == 100 * 20 and len(ann._top(np.ones((3, 2)), np.arange(3), np.ones((500, 2)), np.arange(500), 20)[0]) == 60
    few = v.filter("vec_id < 5")
    assert ann.neighbours(few, few.filter("vec_id = 0")).count() == 4
    assert ann.neighbours(v.filter("vec_id < 0"), v.filter("vec_id < 0")).count() == 0


def test_attach_keeps_every_row_of_hot_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    groups = common.keep(df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "test")
    got = common.attach(df, groups, ["k"], ["id"])
    assert got.count() == 5000 and got.filter("k = 7").select("top").distinct().collect()[0][0] == 4998 and got.filter("top is null").count() == 0


def test_mix_of_huge_and_equal_rows(spark, monkeypatch):
    """Positions beyond 2^53 words stay exact, and rows that are equal in id and text are dealt to several chunks."""
    at = spark.range(1).select(F.lit(30_000_000_000_000).alias("_at"), F.lit(100).alias("size"), F.lit(1 << 46).alias("source_size"))
    assert at.select(F.expr("_at div 64")).first()[0] == 30_000_000_000_000 // 64
    monkeypatch.setattr(mixing, "CHUNK", 64)
    df = spark.createDataFrame([(None, "a b c d e", "s")] * 3000 + [(i, prose(i, 30), "t") for i in range(200)], "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert len(got) == 3200 and (abs(per["taken"] - per["target"]) <= 3 * mixing.BLOCK_WORDS).all() and (got["taken"] <= 3 * got["size"]).all()


def test_sums_before(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("o"), (F.col("id") % 5 + 1).alias("v"))
    got = common.sums_before(df, ["k"], "o", "v", "b").toPandas().sort_values(["k", "o"])
    for _, g in got.groupby("k"):
        assert (g["b"].to_numpy() == np.cumsum(g["v"]) - g["v"]).all()


def test_packing_deals_equal_rows(spark):
    df = spark.createDataFrame([(None, None)] * 3000, "doc_id long, text string")
    got = packing.pack(df, group_rows=500).toPandas()
    assert len(got) == 3000 and got["sequence_id"].nunique() == 6 and got["length"].sum() == 3000
