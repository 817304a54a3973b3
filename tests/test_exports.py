"""Files of suggestions and edit lists, byte by byte; folders, panels and matched files in cases worked out by hand."""

import csv
import io
from pathlib import Path

from pyspark.sql import functions as F

from shotlake.operators import exports, facets, folders, quality, transcript, usage

ROW = (
    "script_id string, beat int, start_s double, end_s double, narration string, missing string, rank int, filename string, shot_start_s double, shot_duration_s double, shot_type string, camera_movement string, setting string, mood array<string>, "
    "reason string, confidence double, reused boolean, drive_link string, media_path string, from_frame int, gap_frames int, fps int"
)


def files(path):
    return {p.parent.name: p.read_bytes().decode() for p in Path(path).glob("script=*/part-*.txt")}


def test_csv_files(spark, tmp_path):
    rows = [
        ("a", 1, 5.0, 6.5, "two", "no sea", *[None] * 15, 25),
        ("a", 0, 0.0, 5.0, 'He said "go",\nthen', None, 2, "y.mp4", 3.0, 1.0, None, None, None, [], "-x", 0.5, True, "http://l", "/m/y", 10, 5, 25),
        ("a", 0, 0.0, 5.0, 'He said "go",\nthen', None, 1, "=x.mp4", 3661.2, 2.5, "wide", "pan", "beach", ["calm", "warm"], "-1 is fine", 0.876, False, None, "/m/x", 250, 5, 25),
        *[("b c", i, float(i), i + 1.0, f"n{i}", None, *[None] * 15, 25) for i in range(30)],
    ]
    df = spark.createDataFrame(rows, ROW).repartition(5)
    got = files(exports.write_files(exports.suggestion_lines(df), str(tmp_path), mark=True))
    assert set(got) == {"script=a", "script=b c"} and all(t.startswith("﻿beat,") for t in got.values())
    table = list(csv.DictReader(io.StringIO(got["script=a"].removeprefix("﻿"))))
    assert [(r["beat"], r["rank"], r["status"]) for r in table] == [("1", "1", "placed"), ("1", "2", "alternative"), ("2", "", "no good match")]
    first, second, third = table
    assert first["filename"] == "'=x.mp4" and first["narration"] == 'He said "go",\nthen' and first["shot_timecode"] == "01:01:01" and first["mood"] == "calm; warm" and first["reason"] == "-1 is fine" and first["confidence"] == "0.88"
    assert (first["local_path"], first["sequence_timecode"], first["gap_s"], first["reused"]) == ("/m/x", "00:00:10:00", "0.20", "")
    assert (second["local_path"], second["sequence_timecode"], second["gap_s"], second["reused"], second["reason"], second["drive_link"]) == ("", "", "", "yes", "'-x", "http://l")
    assert third["reason"] == "no sea" and third["beat_start"] == "5.000" and third["filename"] == ""
    assert [r["narration"] for r in csv.DictReader(io.StringIO(got["script=b c"].removeprefix("﻿")))] == [f"n{i}" for i in range(30)]


def test_edit_files(spark, tmp_path):
    rows = [("t", 1, "s2", "beach.mp4", 50, 25, 25, 75, "Film", None, "and " * 30, "", 25), ("t", 0, "s1", "sea.mp4", 0, 25, 0, 25, "Film", "/m/sea.mp4", "hello", "because", 0), ("u", 0, "s1", "sea.mp4", 0, 25, 0, 25, None, None, "x", None, None)]
    df = spark.createDataFrame(rows, "script_id string, beat int, source_id string, name string, source_in int, frames int, from_frame int, to_frame int, title string, media_path string, narration string, reason string, gap_frames int")
    got = files(exports.write_files(exports.edit_lines(df, 25), str(tmp_path)))
    assert got["script=t"].split("\n") == [
        "TITLE: Film", "FCM: NON-DROP FRAME", "", "001  SEAX0001 V     C        00:00:00:00 00:00:01:00 00:00:00:00 00:00:01:00", "* FROM CLIP NAME: sea.mp4", "* SOURCE FILE: /m/sea.mp4", "* BEAT: hello", "* REASON: because", "",
        "002  BEAC0002 V     C        00:00:02:00 00:00:03:00 00:00:01:00 00:00:03:00", "* FROM CLIP NAME: beach.mp4", f"* BEAT: {('and ' * 30)[:70]}", "* GAP AFTER: 25 frames (1.0s) - clip is shorter than the beat", "",
    ]
    assert got["script=u"].startswith("TITLE: \n")


def test_kinds_of_transcripts(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nHi"
    rows = [("a.vtt", "no times"), ("a.txt", " webvtt\n\n" + srt), ("a.srt", srt), ("A.SRT", "no times"), ("a.txt", srt), ("a.txt", "x" * 3000 + srt), (None, "words"), ("b.srt", "﻿" + "y" * 3000 + srt)]
    df = spark.createDataFrame(rows, "name string, text string")
    assert [r[0] for r in df.select(transcript.kind(F.col("name"), F.col("text"))).collect()] == ["vtt", "vtt", "srt", "plain", "srt", "plain", "plain", "srt"]


def test_client_tree(spark):
    rows = [
        ("f1", "f1-0", 0, 5.0, "A/x", ["A/y", "no leaf"], False, True, "Videos"), ("f1", "f1-1", 1, 2.0, "A/y", None, None, None, "Videos"), ("f1", "f1-2", 2, 5.0, "A/z", [], True, False, "Videos"),
        ("f2", "f2-0", 0, 1.0, "A/x", ["A/y"], True, True, None), ("f3", "f3-0", 0, 1.0, "gone", ["A/x"], False, False, None), ("f4", "f4-0", 0, 1.0, None, None, False, False, "Images"),
    ]
    shots = spark.createDataFrame(rows, "source_id string, shot_id string, shot_index int, duration_s double, category string, secondary array<string>, doubt boolean, top_pick boolean, prefix string")
    leaves = spark.createDataFrame([("A/x",), ("A/y",), ("A/z",)], "path string")
    got = {tuple(r) for r in folders.client_tree(shots, leaves).collect()}
    assert got == {
        ("f1", "Videos/A/x", "home", None), ("f1", "Videos/A/y", "also", "f1-0"), ("f1", "Videos/A/y", "also", "f1-1"), ("f1", "Videos/Top picks", "pick", "f1-0"), ("f2", "To review", "home", None), ("f2", "Top picks", "pick", "f2-0"),
        ("f3", "Unsorted", "home", None), ("f3", "A/x", "also", "f3-0"), ("f4", "Images/Unsorted", "home", None),
    }
    free = {tuple(r)[:3] for r in folders.client_tree(shots.filter("source_id = 'f2'"), leaves, picks=None, route=False).collect()}
    assert free == {("f2", "A/x", "home"), ("f2", "A/y", "also")}


def test_matched_files(spark):
    local = spark.createDataFrame([(1, "B.mp4", "AA", 5), (2, "b.mp4", "aa", 5), (3, "c.mp4", "aa", 6), (4, "d.mp4", "bb", 7), (5, "e.mp4", None, 7), (6, "f.mp4", "cc", 0), (7, "new.mp4", "aa", 5)], "id int, name string, md5 string, size long")
    originals = spark.createDataFrame([("o2", "b.mp4", "aa", 5), ("o1", "z.mp4", "aa", 5), ("o3", "d.mp4", "BB", 7), ("o4", "f.mp4", "cc", 0)], "orig_id string, orig_name string, md5 string, size long")
    got = {r["id"]: tuple(r)[1:] for r in usage.match_files(local, originals, spark.createDataFrame([("o3",)], "orig_id string")).collect()}
    assert got == {1: ("o2", True, 2, "matched"), 2: ("o2", False, 2, "duplicate"), 3: (None, None, None, "unmatched"), 4: ("o3", False, 1, "already_indexed"), 5: (None, None, None, "unmatched"), 6: (None, None, None, "unmatched"), 7: ("o1", True, 2, "matched")}


def test_job_panel_and_waits(spark):
    rows = [("l", 1, "done", "2024-01-03", None), ("l", 2, "running", "2024-01-01", None), ("l", 3, "queued", "2024-01-02", "429: requests Per Day"), ("l", 4, "queued", "2024-01-05", "no such file"), ("l", 5, "cancelled", "2024-01-09", None), ("l", 6, "failed", "2024-01-03", "503"), ("m", 7, "queued", "2024-01-01", "")]
    jobs = spark.createDataFrame(rows, "workspace_id string, job_id int, status string, created_at string, last_error string")
    assert [r["job_id"] for r in facets.recent_jobs(jobs, 4).filter("workspace_id = 'l'").orderBy("place").collect()] == [2, 4, 3, 1]
    assert sorted(map(tuple, facets.waits(jobs, quality.transient(F.col("last_error"))).collect())) == [("l", 1, True), ("m", 0, False)]
    assert sorted(map(tuple, facets.jobs_by_side(jobs, F.lit("video")).collect())) == [("l", "video", 2, 1, 1, 1), ("m", "video", 1, 0, 0, 0)]
