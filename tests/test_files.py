import json
import os

import pytest
from pyspark.sql import functions as F

from reprise.sources import feeds as fd
from reprise.sources import files


def names(errors):
    return {os.path.basename(r["path"]): r["error"] for r in errors.collect()}


def test_transcripts_and_two_broken(spark, tmp_path):
    seg = lambda s, t: {"start": s, "end": s + 1.5, "text": t}
    (tmp_path / "1.json").write_text(json.dumps([seg(0, "one"), seg(2, "zwei\nlines")]))
    (tmp_path / "2.json").write_text(json.dumps({"language": "en", "segments": [seg(5, "three"), {"start": 7}]}))
    (tmp_path / "3.json").write_text('{"segments": [')
    (tmp_path / "4.json").write_bytes(b'["\xff\xfe"]')
    (tmp_path / "5.json").write_text("[]")
    (tmp_path / "6.json").write_text('{"text": "no list"}')
    (tmp_path / "seven.json").write_text("[]")
    (tmp_path / "8.json").write_text("")
    rows, errors = files.scan_transcripts(spark, f"file://{tmp_path}")
    assert {(r["episode_id"], r["seg_idx"]): (r["start"], r["end"], r["text"]) for r in rows.collect()} == {(1, 0): (0, 1.5, "one"), (1, 1): (2, 3.5, "zwei\nlines"), (2, 0): (5, 6.5, "three"), (2, 1): (7, None, None)}
    assert names(errors) == {"3.json": "not JSON", "4.json": "not UTF-8", "6.json": "no list of segments", "seven.json": "no id in the file's name", "8.json": "not JSON"}
    keyed, none = files.scan_transcripts(spark, str(tmp_path), F.crc32(F.encode("name", "UTF-8")))
    assert keyed.count() == 4 and "seven.json" not in names(none)


def test_chapters_and_silences(spark, tmp_path):
    for d in ("c", "s"):
        (tmp_path / d).mkdir()
    (tmp_path / "c" / "1.json").write_text('{"version": "1", "chapters": [{"startTime": 0, "title": "a"}, {"startTime": 9.5, "title": "Ad", "endTime": 12}]}')
    (tmp_path / "c" / "2.json").write_text("{}")
    (tmp_path / "c" / "3.json").write_text("<html>")
    (tmp_path / "c" / "4.json").write_text("[1]")
    rows, errors = files.scan_chapter_files(spark, str(tmp_path / "c"))
    assert {tuple(r) for r in rows.collect()} == {(1, 0, "a", 0.0, None), (1, 1, "Ad", 9.5, 12.0)}
    assert names(errors) == {"3.json": "not JSON", "4.json": "not an object"}
    (tmp_path / "s" / "1.log").write_text("x\r\n[a] silence_start: 1.5\r\n[a] silence_end: 2.25 | silence_duration: 0.75\n[a] silence_start: 9\n")
    (tmp_path / "s" / "2.log").write_text("silence_end: 3\nsilence_start: 4\nsilence_end: 5")
    (tmp_path / "s" / "3.log").write_bytes(b"\xff")
    rows, errors = files.scan_silence_logs(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in rows.collect()} == {(1, 1.5, 2.25), (2, 4.0, 5.0)} and names(errors) == {"3.log": "not UTF-8"}


@pytest.fixture(scope="module")
def shows(spark):
    feeds = spark.range(6).select("id", F.concat(F.lit("http://f/"), "id").alias("source_url"), F.lit("T & T").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("image_url"))
    e = spark.range(200).select("id", (F.col("id") % 5).alias("feed_id"), F.concat(F.lit("g"), "id").alias("guid"), F.lit("t").alias("title"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("2026-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))).alias("pubdate"), F.lit("http://a").alias("audio_url"), F.lit(None).cast("string").alias("cut_path"))
    return feeds, e


def test_feed_files_equal_feed_texts(spark, shows, tmp_path):
    feeds, episodes = shows
    (tmp_path / "99.xml").write_text("another feed")
    for _ in range(2):  # a second run replaces the files
        files.write_rss(feeds, episodes, "http://h", str(tmp_path))
    want = {f"{r['feed_id']}.xml": r["xml"] for r in fd.rss(feeds, episodes, "http://h").collect()}
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if p.suffix == ".xml" and p.name != "99.xml"} == want and len(want) == 6
    assert sorted(os.listdir(tmp_path)) == sorted([*want, "99.xml"])


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(files.OneFileAKey)
    bad = spark.createDataFrame([("a.xml", "x"), ("b.xml", "y"), ("../c.xml", "z")], "file string, part string").repartition(3, "file")
    with pytest.raises(Exception, match="name of a file"):
        bad.write.format("one_file_a_key").mode("append").save(str(tmp_path))
    assert [n for n in os.listdir(tmp_path) if not n.startswith("_job-")] == []  # a task being killed may still write there
    twice = spark.createDataFrame([("a.xml", "x"), ("a.xml", "y")], "file string, part string").repartition(2)
    with pytest.raises(Exception, match="several tasks"):
        twice.write.format("one_file_a_key").mode("append").save(str(tmp_path))
    assert [n for n in os.listdir(tmp_path) if not n.startswith("_job-")] == []  # a task being killed may still write there
