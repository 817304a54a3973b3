"""Rules of segments, curation and shortlists in cases worked out by hand."""

from pyspark.sql import functions as F

from shotlake.operators import catalog, engine, facets, hybrid, index, quality, segments, transcript, vector


def test_short_spans_join_what_is_before(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 8.0), ("b", 0.2, 1.0), ("b", 1.0, 9.0), ("b", 9.0, 9.5), ("b", 9.5, 14.0), ("c", 0.0, 1.6), ("c", 1.6, 3.2), ("d", 0.5, 1.0), ("e", 0.0, 1.0), ("e", 1.0, 1.3), ("e", 1.3, 9.0)]
    spans = spark.createDataFrame(rows, "id string, x double, y double").withColumn("length", F.when(F.col("id") == "b", 15.0).when(F.col("id") == "d", 4.0).otherwise(F.lit(3.0)))
    got = sorted(map(tuple, segments.merge_cuts(spans).collect()))
    assert got == [("a", 0.0, 2.0), ("a", 2.0, 8.0), ("b", 0.0, 9.5), ("b", 9.5, 15.0), ("c", 0.0, 3.0), ("d", 0.0, 4.0), ("e", 0.0, 9.0)]


def test_trim(spark):
    row = "start_s double, end_s double, length_s double, lo double, hi double"
    cut = lambda *r, **k: tuple(spark.createDataFrame([r], row).select(*segments.trim(2.0, k.get("longest", 30.0), ("lo", "hi"))).first())
    assert cut(10.0, 60.0, 100.0, None, None) == (8.0, 42.0, False)
    assert cut(10.0, 60.0, 100.0, 20.0, 25.0) == (18.0, 27.0, False)
    assert cut(1.0, 9.0, 10.0, None, None) == (0.0, 10.0, True)
    assert cut(1.0, 9.0, None, None, 5.0) == (0.0, 11.0, True)
    assert cut(10.0, 60.0, 61.0, None, None, longest=None) == (8.0, 61.0, False)


def test_frames(spark):
    n = spark.createDataFrame([(0.0,), (4.0,), (18.0,), (60.0,)], "d double").select(segments.frame_count(F.col("d")))
    assert [r[0] for r in n.collect()] == [3, 3, 4, 8]
    rows = [("a", 0.0, 40.0, 8, 10.0, 20.0), ("b", 0.0, 40.0, 3, 10.0, 20.0), ("c", 0.0, 10.0, 4, 1.0, 9.5), ("d", 0.0, 10.0, 4, None, None), ("e", 0.0, 20.0, 5, 0.0, 5.0), ("f", 0.0, 20.0, 4, 0.6, 10.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double, count int, lo double, hi double")
    got = {k: [r["t"] for r in segments.weighted_times(df).filter(F.col("id") == k).orderBy("k").collect()] for k in "abcdef"}
    assert got["a"] == [2.5, 7.5, 11.666667, 15.0, 18.333333, 23.333333, 30.0, 36.666667]  # three inside; of five others two before, as 5 x 10 / 30 is nearer to two
    assert got["b"] == [6.666667, 20.0, 33.333333] and got["c"] == got["d"] == [1.25, 3.75, 6.25, 8.75]
    assert got["e"] == [1.25, 3.75, 7.5, 12.5, 17.5]
    assert got["f"] == [0.3, 2.95, 7.65, 15.0]


def test_a_short_last_beat_always_folds():
    assert transcript.merge_fold([[0, 14, "a", False], [14, 16, "b", False]], 3, 15) == [[0, 16, "a b", False]]
    assert transcript.merge_fold([[0, 14, "a", False], [14, 16, "b", True]], 3, 15) == [[0, 14, "a", False], [14, 16, "b", True]]
    assert transcript.merge_fold([], 3, 15) == []


def test_audit_of_tags(spark):
    tags = spark.createDataFrame([(i, "rain") for i in range(20)] + [(i, "man") for i in range(50)] + [(1, "once"), (1, "once")], "shot_id int, tag string")
    by = {r["tag"]: r for r in facets.tag_audit(tags, 100).collect()}
    assert by["rain"]["too_common"] and not by["man"]["too_common"] and by["once"]["single"]
    assert not any(r["too_common"] for r in facets.tag_audit(tags.filter("shot_id < 20"), 20).collect())
    shots = spark.createDataFrame([("a", ["x", "y"], "needs_review"), ("b", ["x"], "indexed"), ("c", None, "indexed")], "shot_id string, tags array<string>, status string")
    assert sorted(map(tuple, facets.audit_report(shots, 1).collect())) == [("distinct_tags", "", 2.0), ("most", "x", 2.0), ("needs_review", "", 1.0), ("shots", "", 3.0), ("tags_per_shot", "", 1.0), ("tags_used_once", "", 1.0)]


def test_intake(spark):
    rows = [("video", 725.0, 10, False, None), ("image", 9e9, 10, False, None), ("video", 725.0, 10, True, None), ("video", 4000.0, 10, True, None), ("video", 5.0, 6_000_000_000, False, None), ("video", 5.0, 6_000_000_000, True, None), ("video", 5.0, 6_000_000_000, True, 8_000_000_000), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "media_kind string, duration_s double, filesize_bytes long, forced boolean, free long")
    got = [tuple(r) for r in df.select(*catalog.intake(F.col("forced"), F.col("free"))).collect()]
    assert [g[0] for g in got] == ["too_long", None, None, "too_long", "too_big", None, "too_big", None]
    assert got[0][1] == "12 min 05 s long; the limit is 10 min 00 s. Probably a recording rather than B-roll."
    assert got[3][1].startswith("1 h 06 min long; the limit is 1 h 00 min") and got[4][1] == "6.0 GB; the limit is 5 GB."
    assert got[6][1] == "6.0 GB is more than this server can hold at once (3.0 GB free to use)."


def test_evidence_reasons_and_failures(spark):
    df = spark.createDataFrame([(["rain", "calm", "hope", "ann", "video", "rain", "serene"], ["hope", "other"], "a calm lake in rain"), (None, None, None)], "tags array<string>, themes array<string>, text string")
    tags, themes = quality.evidence(F.col("tags"), F.col("themes"), F.col("text"), ("video",), ("ann",), ("calm", "serene"), ("hope", "serene", "loss"))
    assert [tuple(r) for r in df.select(tags, themes).collect()] == [(["rain", "calm"], ["hope", "serene"]), ([], [])]
    df = spark.createDataFrame([(0.69, 0.59, True, ["shaky"]), (0.7, 0.6, False, ["dark"]), (None, None, None, None)], "c double, k double, u boolean, f array<string>")
    got = [r[0] for r in df.select(quality.review_reasons(F.col("c"), F.col("k"), F.col("u"), F.col("f"), ("shaky",))).collect()]
    assert got == [["low_confidence", "low_category_confidence", "category_unmatched", "quality_defect"], [], []]
    said = ["No free disk", "download: incomplete file", "moov atom", "what", None, "503", "billing is off", "x googleapis.com/drive/v3/files 403 y"]
    rows = spark.createDataFrame([(s,) for s in said], "m string").select(*(f(F.col("m")) for f in (quality.failure_kind, quality.transient, quality.environment, quality.drive_quota))).collect()
    assert [r[0] for r in rows] == ["too_big", "download_incomplete", "unreadable"] + ["analysis_failed"] * 5
    assert [tuple(r)[1:] for r in rows][4:] == [(False, False, False), (True, False, False), (True, True, False), (True, True, True)]


def test_candidates_by_verdict(spark):
    hits = [(1, 0, 1, "s1", "a", "weak", 0.9), (1, 0, 2, "s1", "b", "match", 0.1), (1, 1, 1, "s2", "c", "near", 0.5), (1, 1, 2, "s1", "d", "match", 0.9), (1, 1, 3, "s3", "e", "match", 0.4), (1, 0, 3, "s2", "c", "match", 0.3), (1, 0, 4, "s4", "f", None, None)]
    df = spark.createDataFrame(hits, "beat int, idea int, rank int, source_id string, shot_id string, label string, similarity double")
    assert [r["shot_id"] for r in transcript.candidates(df, 2, 9).orderBy("place").collect()] == ["e", "c", "b", "a", "f"]
    assert [r["shot_id"] for r in transcript.candidates(df.drop("label", "similarity"), 2, 3).orderBy("place").collect()] == ["a", "c", "b"]


def test_names(spark):
    rows = [("Ann's boat", "Ann Lee"), ("ann lee in Annecy", "Ann Lee"), ("lee of the isle", "Ann Lee"), ("Jo walks", "Jo (J.) Ray"), ("Jo (J.) Ray walks", "Jo (J.) Ray"), ("nobody", None), ("nobody", " "), ("Zoë's zoëlle", "Zoë")]
    df = spark.createDataFrame(rows, "text string, name string")
    got = [tuple(r) for r in df.select(*hybrid.without_person(F.col("text"), F.col("name"))).collect()]
    assert got == [("boat", True), ("in Annecy", True), ("of the isle", True), ("Jo walks", False), ("walks", True), ("nobody", False), ("nobody", False), ("zoëlle", True)]


def test_what_a_search_reads_out_of_a_query(spark):
    """A name filters and browses; kinds of shot are asked for in every field; queries without index words go by vector; browses are newest first."""
    docs = [(1, "a man on a tripod box", "wide", "static", True, "2024-01-01"), (2, "a man walks by the sea", "wide", "pan", True, "2024-03-01"), (3, "people eating lunch by the sea", "wide", "static", False, "2024-02-01"), (4, "boats at sea", "close_up", "static", False, "2024-04-01"), (5, "empty sea", None, None, None, None)]
    d = spark.createDataFrame(docs, "doc long, text string, shot_type string, camera_movement string, featured boolean, created_at string")
    v = d.select("doc", vector.normalised(F.array(F.col("doc").cast("double"), F.lit(1.0))).alias("v"))
    lib = engine.Library(index.build(d, "doc", {"text": 1.0}), spark.createDataFrame([("footage",)], "word string"), v, d.drop("text"), "Ann Lee")
    asked = ["Ann", "wide shot tripod", "show me some footage", "close-ups", "sea", "Ann by the sea", "", "Ann wide shot", "handheld"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(len(asked))], "query_id long, q array<double>")
    got = engine.search(q, vectors, lib, 5, "annotate")[0].orderBy("query_id", "rank").collect()
    by = {k: [r["doc"] for r in got if r["query_id"] == k] for k in range(len(asked))}
    assert by[0] == [2, 1] and by[1] == [3, 1] and by[3] == [4] and by[6] == [4, 2, 3, 1, 5] and by[7] == [2, 1] and by[8] == []
    assert set(by[2]) == {1, 2, 3, 4, 5} and {r["matched"] for r in got if r["query_id"] == 2} == {"vector"}
    assert set(by[4]) == {1, 2, 3, 4, 5} and set(by[5]) == {1, 2}
    free = engine.search(q, vectors, lib, 5, "annotate", person_filter=False)[0].collect()
    assert {r["doc"] for r in free if r["query_id"] == 5} == {1, 2, 3, 4, 5}
    few = engine.search(q, vectors, lib, 5, "annotate", allowed=d.filter("doc <> 2").select("doc"))[0].collect()
    assert {r["doc"] for r in few if r["query_id"] == 0} == {1}
