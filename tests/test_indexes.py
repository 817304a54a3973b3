"""Indexes, versions and states against brute force on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.operators import filters, keyword, quantised, segmented, vector, versions


def unit(points):
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)


def test_lists_on_clusters(spark):
    """Clustered vectors: recall of 20 nearest with under a tenth of the pairs looked at, distances exact."""
    rng = np.random.default_rng(2)
    points = unit(np.repeat(unit(rng.normal(0, 1, (60, 32))), 50, axis=0) + rng.normal(0, 0.06, (3000, 32)))
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "doc long, v array<double>")
    q = v.filter("doc % 20 = 0").select(F.col("doc").alias("query_id"), F.col("v").alias("q"))
    lists = quantised.measured(quantised.build(v), 20)
    found = {(r["query_id"], r["doc"]): r["distance"] for r in quantised.search(lists, q, 20).collect()}
    exact = {(r["query_id"], r["doc"]): r["distance"] for r in vector.nearest(q, v, 20).collect()}
    assert len(found) == len(exact) == 150 * 20
    assert sum(k in found for k in exact) / len(exact) >= 0.9
    assert all(exact[k] == pytest.approx(d) for k, d in found.items() if k in exact)
    assert quantised.compared(lists, q, 20) < 0.1


def test_lists_of_few(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)] + [(9, [0.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0])], "doc long, v array<double>")
    q = v.select(F.col("doc").alias("query_id"), F.col("v").alias("q"))
    lists = quantised.measured(quantised.build(v), 2)
    lists.probes = len(lists.cells)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(quantised.search(lists, q, 2)) == rows(vector.nearest(q, v, 2))
    assert quantised.search(lists, q.filter("query_id = 99"), 2).count() == 0
    with pytest.raises(ValueError):
        quantised.build(v.filter("doc = 99"))


SHOT = "shot_id string, status string, shot_type string, mood array<string>, duration_s double, media_kind string, width double, category string, secondary array<string>, quality_flags array<string>, top_pick boolean, created_at double, tokens int"


def filter_rows():
    """Shots with nulls in every column, repeated ones, and a column that is named like one of the index."""
    rng, rows = np.random.default_rng(6), []
    some = lambda values: values[int(rng.integers(0, len(values)))]
    for i in range(400):
        rows.append((f"s{i % 390}", some(["indexed", "needs_review", "failed", None]), some(["wide", "medium", None]), some([["calm"], ["calm", "warm"], [], None]), some([1.0, 5.0, 5.0, 30.0, None]), some(["video", "image", None]), some([640.0, 1280.0, 1920.0, None]), some(["a", "a/b", "a/b/c", "a_b/c", "ab", None]), some([["a/b"], ["x", "a"], [], None]), some([[], ["shaky"], ["shaky", "dark"], []]), some([True, False, None]), some([100.0, 200.0, 300.0, None]), 1))
    return rows


SPECS = [
    (1,) + (None,) * 13,
    (2, {"shot_type": ["wide"], "mood": ["calm", "cold"]}, None, None, None, None, None, None, None, None, None, None, None, None),
    (3, None, {"duration_s": 5.0}, {"duration_s": 5.0}, None, None, None, None, None, None, None, None, None, []),
    (4, None, {"duration_s": 6.0, "width": 1280.0}, {"created_at": 200.0}, {"top_pick": True}, None, None, None, None, None, None, None, None, None),
    (5, None, None, None, None, ["a/b"], None, None, None, None, None, None, None, []),
    (6, None, None, None, None, ["a", "ab"], True, None, None, None, None, None, None, []),
    (7, None, None, None, None, ["a"], False, True, None, ["shaky"], ["dark"], None, ["s3", "s5", "nobody"], []),
    (8, None, None, None, {"top_pick": False}, [], None, None, True, None, None, None, None, ["failed"]),
    (9, {"shot_type": []}, None, None, None, None, None, None, None, None, None, True, None, None),
    (10, None, {"duration_s": 20.0}, {"duration_s": 2.0}, None, None, None, None, None, None, None, None, None, []),
    (11, {"shot_type": ["none such"]}, None, None, None, None, None, None, None, None, None, None, None, None),
    (2, {"shot_type": ["wide"], "mood": ["calm", "cold"]}, None, None, None, None, None, None, None, None, None, None, None, None),
]


def brute_filter(row, spec):
    shot, status, kind, mood, duration, media, width, category, second, flags, top, created, _ = row
    _, any_of, low, high, flag, folders, direct, primary, unfiled, all_flags, no_flags, clean, exclude, statuses = spec
    value = {"shot_type": [kind], "mood": mood or [], "duration_s": duration, "width": width, "created_at": created, "top_pick": top}
    statuses = ["indexed", "needs_review"] if statuses is None else statuses
    ok = not statuses or status in statuses
    ok &= all(not vs or bool(set(vs) & set(value[c])) for c, vs in (any_of or {}).items())
    for bounds, beyond in ((low, lambda v, b: v < b), (high, lambda v, b: v > b)):
        for c, b in (bounds or {}).items():
            ok &= (value[c] is not None and not beyond(value[c], b)) or (c == "duration_s" and media == "image")
    ok &= all(value[c] is not None and value[c] == v for c, v in (flag or {}).items())
    if folders:
        inside = lambda p, f: p is not None and (p == f or (not direct and p.startswith(f + "/")))
        ok &= any(inside(category, f) or (not primary and any(inside(p, f) for p in second or [])) for f in folders)
    ok &= not unfiled or category is None
    ok &= set(all_flags or []) <= set(flags) and not set(no_flags or []) & set(flags) and (not clean or not flags)
    return bool(ok) and shot not in (exclude or [])


def test_filter_index(spark):
    rows = filter_rows()
    df = spark.createDataFrame(rows, SHOT)
    tokens = filters.shot_tokens(df, ["shot_type", "status", "media_kind"], ["mood"], ["duration_s", "width", "created_at"], ["top_pick"])
    specs = spark.createDataFrame(SPECS, filters.SPEC.format("int"))
    got = sorted(map(tuple, filters.matches(tokens, specs).collect()))
    want = sorted((s[0], r[0]) for s in SPECS for r in rows if brute_filter(r, s))
    assert got == want
    assert filters.matches(tokens.filter("false"), specs).count() == 0
    assert filters.matches(tokens, specs.filter("false")).count() == 0


def test_versions(spark, tmp_path):
    table = versions.Versioned(spark, str(tmp_path / "t"), "id", 8)
    base = spark.createDataFrame([(f"k{i}", i, "old") for i in range(50)], "id string, n long, s string")
    rows = lambda v=None: sorted(map(tuple, table.read(v).collect()))
    assert table.version() == -1
    with pytest.raises(ValueError):
        table.read()
    assert table.write(base) == 0
    first = {r["bucket"]: r["path"] for r in table.commits.get()[1]}
    assert table.write(spark.createDataFrame([("k3", None, "new"), ("z", 7, None)], "id string, n long, s string"), spark.createDataFrame([("k4",), ("nobody",)], "id string")) == 1
    want = sorted([(f"k{i}", i, "new" if i == 3 else "old") for i in range(50) if i != 4] + [("z", 7, None)])
    assert rows() == want and rows(0) == sorted((f"k{i}", i, "old") for i in range(50))
    second = {r["bucket"]: r["path"] for r in table.commits.get()[1]}
    assert 0 < sum(first.get(b) != p for b, p in second.items()) <= 4 < len(second)  # only buckets with a changed key
    table.write(deleted=base.select("id"))
    table.write(deleted=spark.createDataFrame([("z",)], "id string"))
    assert rows() == [] and table.read().columns == ["id", "n", "s"] and rows(1) == want
    table.write(base.limit(1))
    assert len(rows()) == 1


def test_a_failed_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = versions.Versioned(spark, str(tmp_path / "t"), "id", 4)
    table.write(spark.createDataFrame([("a", 1)], "id string, n long"))
    more = spark.createDataFrame([("a", 2), ("b", 2)], "id string, n long")

    def lost(*_):
        raise OSError("the driver is lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(table.commits, "put", lost)
        with pytest.raises(OSError):
            table.write(more)
    assert table.version() == 0 and [tuple(r) for r in table.read().collect()] == [("a", 1)]
    broken = more.select("id", F.when(F.col("id") == "b", F.raise_error(F.lit("a task fails"))).otherwise(F.col("n")).cast("long").alias("n"))
    with pytest.raises(Exception, match="a task fails"):
        table.write(broken)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
    assert table.write(more) == 1 and table.read().count() == 2


def test_one_of_two_writers_wins(spark, tmp_path):
    a, b = (versions.Commits(spark, str(tmp_path / "c"), "x int") for _ in range(2))
    a.put(0, [(1,)])
    lost = 0
    for w in (a, b):
        try:
            w.put(1, [(2,)])
        except versions.Conflict:
            lost += 1
    assert a.get()[0] == 1 and lost <= 1 and a.get(0)[1][0]["x"] == 1
    assert len({n for n in a._all().values()}) == 2


TEXTS = {"text": 1.0, "concept": 0.6}
CHANGE = "doc_id long, text string, concept string, deleted boolean, at long"


def change_batches(seed):
    rng = np.random.default_rng(seed)
    words = ["red", "Blue", "sea", "sand", "été", "x1", ""]
    batches, n = [], 0
    for _ in range(9):
        batch = []
        for _ in range(int(rng.integers(0, 12))):
            n += 1
            gone = bool(rng.random() < 0.3)
            batch.append((int(rng.integers(0, 15)), None if gone and n % 2 else " ".join(rng.choice(words, 5)), str(rng.choice(words)), gone or (None if n % 5 == 0 else False), n))
        batches.append(batch)
    return batches


@pytest.mark.parametrize("seed", [1, 2])
def test_index_in_step(spark, tmp_path, seed):
    """Adds, edits, deletes and documents that come back, with merges on the way: postings, lengths, D4 to D7 equal a rebuild."""
    index = segmented.Segmented(spark, str(tmp_path / "i"), "doc_id", "long", TEXTS, fan=2, smallest=4)
    state = {}
    for k, batch in enumerate(change_batches(seed)):
        df = spark.createDataFrame(batch, CHANGE)
        assert index.apply(df, k) == k
        for doc, text, concept, gone, _ in batch:
            state.pop(doc, None)
            if not gone:
                state[doc] = (text, concept)
    assert index.apply(df, 3) == 8  # handed over again: nothing changes
    tokens = keyword.tokenised(spark.createDataFrame([(d, *t) for d, t in state.items()], "doc_id long, text string, concept string"), "doc_id", TEXTS)
    posts = keyword.postings(tokens)
    same = lambda a, b: sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    assert same(index.postings(), posts) and same(index.lengths(), tokens.select("doc", "len"))
    q = spark.createDataFrame([(1, "red"), (1, "ete"), (2, "sea"), (2, "none")], "query_id long, term string")
    assert same(keyword.frequencies(index.postings()), keyword.frequencies(posts)) and same(keyword.vocabulary(index.postings()), keyword.vocabulary(posts))
    found = keyword.bm25(q, posts, tokens, 5)
    assert same(keyword.bm25(q, index.postings(), index.lengths(), 5), found)
    assert same(keyword.coverage(q, found.select("query_id", "doc"), index.postings(), index.lengths().count()), keyword.coverage(q, found.select("query_id", "doc"), posts, tokens.count()))
    assert len(index.segments()) < 9


def test_index_follows_a_stream(spark, tmp_path):
    for k, batch in enumerate(change_batches(3)[:3]):
        spark.createDataFrame(batch + [(100 + k, "always here", "c", False, 1)], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index = segmented.Segmented(spark, str(tmp_path / "i"), "doc_id", "long", TEXTS)
    index.follow(stream, str(tmp_path / "cp"))
    assert {r["doc"] for r in index.lengths().collect()} >= {100, 101, 102}
    before = index.commits.get()[0]
    index.follow(stream, str(tmp_path / "cp"))
    assert index.commits.get()[0] == before
