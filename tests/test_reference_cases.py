"""The known cases: cuts, snapping, runs, alignment, cold start, campaigns, bytes, feeds, queues."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from reprise.functions import scalars as S
from reprise.functions import staging
from reprise.operators import bytesdiff, campaigns, chapters, detect, graph, intervals, queues, sequence, text, tiers
from reprise.sources import feeds
from reprise.streaming import index


@pytest.mark.parametrize(
    "ads,keep",
    [
        ([], [(0, 100)]), ([(40, 60)], [(0, 40), (60, 100)]), ([(0, 10), (90, 100)], [(10, 90)]), ([(60, 70), (40, 65)], [(0, 40), (70, 100)]),
        ([(10, 20), (20, 30)], [(0, 10), (30, 100)]), ([(90, 150)], [(0, 90)]), ([(0, 100)], []),
    ],
)
def test_keep_spans(spark, ads, keep):
    a = spark.createDataFrame([(1, float(x), float(y)) for x, y in ads], "e long, start double, end double")
    d = spark.createDataFrame([(1, 100.0)], "e long, duration double")
    assert sorted((r["start"], r["end"]) for r in intervals.keep_spans(a, d, "e").collect()) == keep


def test_snap_inward_and_gaps(spark):
    sil = spark.createDataFrame([(1, 100.0, 101.0), (1, 200.0, 201.5), (1, 400.0, 400.4)], "e long, start double, end double")
    s = spark.createDataFrame([(1, 1, 99.5, 202.0), (2, 1, 500.0, 600.0), (3, 1, 400.1, 400.3)], "span_id long, e long, start double, end double")
    got = {r["span_id"]: (r["start"], r["end"]) for r in intervals.snap_inward(s, sil, "e").collect()}
    assert got[1] == (100.0, 201.5) and got[2] == (500.0, 600.0) and got[3][1] > got[3][0]
    gaps = spark.createDataFrame([(1, 60.0, 600.0), (1, 700.0, 1200.0)], "e long, start double, end double")
    assert sorted((r[1], r[2]) for r in intervals.gap_windows(gaps, "e", 120).collect()) == [(60.0, 120.0), (700.0, 760.0)]


@pytest.mark.parametrize("at,bridge,floor,want", [([0, 1, 2, 5, 6, 7], 2, 1, [(0, 7)]), ([0, 1, 2, 5, 6, 7], 1, 1, [(0, 2), (5, 7)]), ([0, 1], 2, 5, [])])
def test_group_runs(spark, at, bridge, floor, want):
    df = spark.createDataFrame([(1, x) for x in at], "e long, p long")
    assert sorted((r["first"], r["last"]) for r in intervals.group_runs(df, ["e"], "p", bridge, floor).collect()) == want


def _frames(spark, episodes):
    return sequence.frames(spark.createDataFrame(list(episodes.items()), "episode_id long, fingerprint array<long>"))


def test_alignment(spark):
    ad, pad = list(range(1000, 1060)), [1] * 20
    q = _frames(spark, {2: pad + ad + pad})
    lib = _frames(spark, {1: ad}).withColumn("ad_id", F.lit(9).cast("long"))
    run = lambda floor: [(r["first"], r["last"]) for r in sequence.match_regions(q, lib, None, 40, floor).collect()]
    assert run(60) == [(20, 79)] and run(61) == [] and run(80) == []
    own = _frames(spark, {2: ad}).withColumn("ad_id", F.lit(9).cast("long"))
    assert sequence.match_regions(q, own, None, 40, 60).count() == 0


def test_cold_start_and_campaigns(spark):
    ad = list(range(1000, 1060))
    eps = {i: list(range(7000, 7100)) + list(range(10**6 * (i + 1), 10**6 * (i + 1) + 100)) + (ad if i < 2 else []) for i in range(8)}
    got = sequence.discover_recurring(_frames(spark, eps), floor=40).collect()
    assert sorted(r["episode_id"] for r in got) == [0, 1]
    assert sequence.discover_recurring(_frames(spark, {0: eps[0]}), floor=40).count() == 0
    a, b, c = (list(range(x, x + 120)) for x in (1000, 2000, 3000))
    gap = lambda i: list(range(10**6 * (i + 1), 10**6 * (i + 1) + 60))
    eps = {i: gap(i) + (a if i < 3 else []) + [10**8 + i * 100 + x for x in range(60)] + (b if i in (2, 3, 4) else []) + (c if i in (5, 6) else []) for i in range(12)}
    runs, links = campaigns.run_links(_frames(spark, eps))
    none = spark.createDataFrame([], "episode_id long, first int, last int")
    got = campaigns.campaign_summary(runs, links, none, 12).collect()
    assert sorted(r["reach"] for r in got) == [2, 3, 3] and not any(r["known"] for r in got)
    cover = campaigns.greedy_set_cover(spark.createDataFrame([("a", 0), ("a", 2), ("b", 2), ("b", 3), ("c", 5), ("c", 6)], "item string, owner long")).collect()
    assert [(r["owner"], r["covers"]) for r in cover] == [(2, 2), (5, 1)]


def test_durations_words_fingerprints(spark):
    d = spark.createDataFrame([("01:02:03",), ("45:00",), ("90",), ("bogus",), (None,), ("inf",)], "t string").select(S.parse_duration(F.col("t"))).collect()
    assert [r[0] for r in d] == [3723, 2700, 90, None, None, None]
    r = spark.range(1).select(S.shingles(S.normalize_words(F.lit("One, two THREE four"))), S.parse_fingerprint(F.lit("1,,4294967297,"))).first()
    assert r[0] == [] and r[1] == [1, 1]
    a = spark.createDataFrame([(400.0, 1000.0), (349.0, 1000.0), (1.0, None), (1.0, 0.0)], "s double, d double")
    assert [r[0] for r in a.select(S.is_anomalous_cut(F.col("s"), F.col("d"))).collect()] == [True, False, False, False]


def test_text_tier(spark):
    lines = lambda e, xs: [(e, i, float(i), i + 1.0, t) for i, t in enumerate(xs)]
    ad = "this show is brought to you by the makers of very fine brushes use code show".split()
    seg = spark.createDataFrame(lines(1, ["hello there my friends and welcome", " ".join(ad)]) + lines(2, ["something else is said here today", " ".join(ad[:9]), " ".join(ad[5:]), "bye now and see you all soon"]), "episode_id long, seg_idx int, start double, end double, text string")
    spans = spark.createDataFrame([(1, 1.0, 2.0, "manual"), (2, 0.0, 1.0, "repeat")], "episode_id long, start double, end double, source string")
    got = text.repeat_detect(seg.where("episode_id = 2"), text.text_library(seg, spans)).collect()
    assert [(r["start"], r["end"], r["source"]) for r in got] == [(1.0, 3.0, "repeat")]


def test_bytes(spark):
    a, tail = bytes(range(256)) * 4, bytes(reversed(range(256))) * 4
    rows = [(1, a, a), (2, a[:600] + b"A" * 300 + tail, a[:600] + b"B" * 500 + tail)]
    df = spark.createDataFrame(rows, "episode_id long, a binary, b binary")
    got = {r["episode_id"]: r for r in bytesdiff.probe_variance(df, 800, 4096, 350, 64).collect()}
    assert got[1]["divergence_byte"] is None and not got[1]["escalated"]
    assert got[2]["divergence_byte"] == 600 and got[2]["reconvergence_byte"] == rows[1][2].find(rows[1][1][950:1014]) and got[2]["escalated"]
    probe = spark.createDataFrame([(1, 20_000, 80_000), (2, 10_000, 900_000), (3, 5, None)], "episode_id long, divergence_byte long, reconvergence_byte long")
    audio = spark.createDataFrame([(i, 1_000_000, 1000.0) for i in (1, 2, 3)], "episode_id long, size long, duration double")
    out = {r["episode_id"]: r for r in bytesdiff.dai_spans(probe, audio).collect()}
    assert (out[1]["start"], out[1]["end"], out[1]["confidence"]) == (22.0, 78.0, 0.5) and out[2]["end"] - out[2]["start"] == 240.0 and out[3]["reject"] == "no realignment"


def test_feeds(spark, tmp_path):
    item = lambda inner: f"<item>{inner}</item>"
    items = [
        item('<title>Tide tables</title><guid isPermaLink="false">kelp/7</guid><pubDate>Tue, 03 Mar 2026 18:30:00 +0200</pubDate><itunes:duration xmlns:itunes="i">00:41:07</itunes:duration><enclosure url="https://media.test/kelp7.ogg" type="audio/ogg"/>'),
        item('<title>Two downloads</title><enclosure url="https://media.test/cover.png" type="image/png"/><enclosure url="https://media.test/two.mp3" type="audio/mpeg"/>'),
        item("<title>No guid, no audio, no link</title>"),
    ]
    (tmp_path / "f.xml").write_text(f"<rss><channel><title>Harbour Notes</title><description>Weekly talk from the quay.</description>{''.join(items)}</channel></rss>")
    got = {r["guid"]: r for r in feeds.scan_rss(spark, str(tmp_path / "f.xml")).collect()}
    assert set(got) == {"kelp/7", "https://media.test/two.mp3"}  # without a guid the audio names the item
    one = got["kelp/7"]
    assert (one["audio_url"], one["pubdate"], one["duration_seconds"]) == ("https://media.test/kelp7.ogg", "2026-03-03T16:30:00Z", 2467)
    assert feeds.scan_channel(spark, str(tmp_path / "f.xml")).first()["title"] == "Harbour Notes"
    listed = '{"chapters":[{"startTime":0,"title":"Fog horns"},{"startTime":210,"title":"promo for ropes","endTime":245.5},{"startTime":300,"title":"Knots"},{"startTime":900,"title":"This week\'s SPONSOR"},{"startTime":1010,"title":"Adrift"},{"startTime":2400,"title":"An advert at the end"}]}'
    ch = feeds.chapters_of(spark.createDataFrame([(5, listed)], "episode_id long, j string"), "episode_id", "j")
    spans = chapters.chapters_tier(ch, spark.createDataFrame([(5, 2467)], "id long, duration_seconds int")).collect()
    assert sorted((r["start"], r["end"]) for r in spans) == [(210.0, 245.5), (900.0, 1010.0), (2400.0, 2467.0)]
    assert {k: len(v.columns) for k, v in feeds.open_store(spark).items()}["ad_segments"] == 8


SPAN = "id long, episode_id long, start double, end double, source string"
EPISODE = "id long, audio_url string, transcript_path string, llm_detected_at string"
LINE = "episode_id long, seg_idx int, start double, end double, text string"


def _key(rows):
    return sorted((r["episode_id"], r["start"], r["end"], r["source"]) for r in rows)


def test_fingerprint_sweep(spark):
    """Confirmed audio is found in another episode, never in its own; silence goes; a second sweep changes nothing."""
    ad, talk = list(range(1000, 1100)), lambda i: list(range(10**5 * i, 10**5 * i + 200))
    eps = {1: talk(1) + ad, 2: ad + talk(2), 3: talk(3), 4: talk(4) + ad}
    frames = _frames(spark, eps)
    sizes = spark.createDataFrame([(i, len(x), len(x) / 10) for i, x in eps.items()], "episode_id long, frames long, duration double")
    spans = spark.createDataFrame([(1, 1, 20.0, 30.0, "manual"), (2, 3, 0.0, 5.0, "fpmatch"), (3, 2, 1.0, 2.0, "repeat")], SPAN)
    episodes = spark.createDataFrame([(i, "u", "t" if i == 4 else None, None) for i in eps], EPISODE)
    lines = spark.createDataFrame([(4, 0, 0.0, 20.0, "many words are spoken here by people")], LINE)
    library, stop = tiers.audio_library(frames, sizes, spans)
    assert library.count() == 100 and stop.count() == 0 and tiers.audio_library(frames, sizes, spans, exclude=1)[0].count() == 0
    assert tiers.editorial_stoplist(frames, sizes, spans).count() == 200  # the 20 s before the span
    want = [(1, 20.0, 30.0, "manual"), (2, 0.0, 10.0, "fpmatch"), (2, 1.0, 2.0, "repeat")]  # 4 has no words there, 3 no match
    one = spark.createDataFrame(tiers.apply_fingerprints(episodes, spans, frames, sizes, lines).collect(), SPAN)
    assert _key(one.collect()) == want and _key(tiers.apply_fingerprints(episodes, one, frames, sizes, lines).collect()) == want
    none = spans.where("source <> 'manual'")
    assert _key(tiers.apply_fingerprints(episodes, none, frames, sizes, lines).collect()) == _key(none.collect())


def test_repeat_sweep(spark):
    read = "this hour comes to you from the makers of quiet umbrellas use code drizzle today"
    lines = [(1, 0, 0.0, 5.0, "welcome back to the harbour everyone tonight"), (1, 1, 5.0, 9.0, read), (2, 0, 0.0, 4.0, read), (2, 1, 4.0, 9.0, "and now the weather for all coasts and isles"), (3, 0, 0.0, 4.0, read)]
    seg = spark.createDataFrame(lines, LINE)
    spans = spark.createDataFrame([(1, 1, 5.0, 9.0, "llm"), (2, 2, 1.0, 3.0, "repeat"), (3, 3, 0.0, 1.0, "repeat")], SPAN)
    episodes = spark.createDataFrame([(i, None, "t" if i < 3 else None, None) for i in (1, 2, 3)], EPISODE)
    want = [(1, 5.0, 9.0, "llm"), (1, 5.0, 9.0, "repeat"), (2, 0.0, 4.0, "repeat"), (3, 0.0, 1.0, "repeat")]  # 3 has no transcript and stays as it was
    one = spark.createDataFrame(tiers.apply_repeats(episodes, spans, seg).collect(), SPAN)
    assert _key(one.collect()) == want and _key(tiers.apply_repeats(episodes, one, seg).collect()) == want


def test_cut_plan(spark):
    spans = spark.createDataFrame([(1, 1, 9.5, 21.0, "manual"), (2, 1, 50.0, 60.0, "recur"), (3, 2, 0.0, 90.0, "llm")], SPAN)
    silences = spark.createDataFrame([(1, 10.0, 11.0), (1, 19.0, 20.5)], "episode_id long, start double, end double")
    timelines = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 10.0)], "episode_id long, duration double")
    keeps, totals = tiers.cut_plan(timelines, spans, silences)
    assert sorted(tuple(r) for r in keeps.collect()) == [(1, 0.0, 10.0), (1, 20.5, 100.0), (2, 90.0, 100.0), (3, 0.0, 10.0)]
    assert sorted(tuple(r) for r in totals.collect()) == [(1, 100.0, 10.5, False), (2, 100.0, 90.0, True), (3, 10.0, 0.0, False)]


def test_detection_goes_on_after_failures(spark):
    def ask(chunk):
        if "broken" in chunk:
            raise ValueError("no answer")
        return [(0, 0, "found")] if "offer" in chunk else None

    text_of = {1: "an offer", 2: "broken", 3: "plain", **{i: "broken" for i in range(4, 9)}, 9: "an offer"}
    seg = spark.createDataFrame([(i, 0, 0.0, 4.0, t) for i, t in text_of.items()], LINE)
    episodes = spark.createDataFrame([(i, None, "t", None) for i in text_of] + [(20, None, "t", "before"), (21, None, None, None)], EPISODE)
    spans, stamped, results = tiers.detect_pending(episodes, spark.createDataFrame([], SPAN), seg, ask, F.lit("now"))
    assert _key(spans.collect()) == [(1, 0.0, 4.0, "llm")]  # 9 comes after five failures in a row
    assert {r["id"]: r["llm_detected_at"] for r in stamped.collect() if r["llm_detected_at"]} == {1: "now", 3: "now", 20: "before"}
    got = {r["episode_id"]: (r["found"], r["error"] is not None) for r in results.collect()}
    assert got == {1: (1, False), 2: (0, True), 3: (0, False), **{i: (0, True) for i in range(4, 9)}}


def test_numbers_follow_the_whole_order(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(3000)]
    got = queues.numbered(spark.createDataFrame(rows, "id long, x long").repartition(7), -F.col("x"), F.col("id"))
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r["id"]: r["_n"] for r in got.collect()} == want


def test_heavy_nodes_of_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 10)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(59, 200)]
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, 200: 0, **{100 + i: 100 for i in range(31)}}


@pytest.mark.parametrize("master", ["spark://head:7077", "yarn", "local-cluster[2,1,1024]"])
def test_staging_needs_a_shared_folder(master):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf)))


def test_upsert_is_idempotent(spark):
    cols = "guid string, title string, pos long"
    new = spark.createDataFrame([("a", "A", 0), ("b", None, 1), ("a", "again", 2)], cols)
    empty = spark.createDataFrame([], "guid string, title string")
    one = queues.upsert(empty, new, ["guid"], ("title",), "pos")
    assert [r["change"] for r in one.collect()] == ["inserted"] * 2
    two = queues.upsert(one.select("guid", "title"), new, ["guid"], ("title",), "pos")
    assert [r["change"] for r in two.collect()] == ["unchanged"] * 2


def test_chunks_ground_and_layers(spark):
    seg = spark.createDataFrame([(1, i, float(i), i + 1.0, f"segment number {i}") for i in range(10)], "episode_id long, seg_idx int, start double, end double, text string")
    skip = seg.where("seg_idx in (2, 3, 4)").select("episode_id", "seg_idx")
    text_ = "\n".join(r["text"] for r in detect.chunks(seg, skip, 100).orderBy("chunk").collect())
    assert "(3 segment(s)" in text_ and "[5] 5.0-6.0: segment number 5" in text_ and "[3]" not in text_
    found = detect.layered(detect.null_detector, detect.model_detector(lambda t: [(1, 2, " x "), (2, 1, ""), (0, 99, "")]))(seg, skip).collect()
    assert [(r["start"], r["end"], r["reason"]) for r in found] == [(1.0, 3.0, "x")]


def test_incremental_index(spark, tmp_path):
    schema = "episode_id long, fingerprint array<long>, duration double, created_at string"
    src, dst, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, [1, 2], 1.0, "a"), (2, [3], 1.0, "a")], schema).write.parquet(src)
    index.index_incrementally(spark, src, schema, dst, ck, 1)
    spark.createDataFrame([(1, [9], 2.0, "b")], schema).write.mode("append").parquet(src)
    index.index_incrementally(spark, src, schema, dst, ck, 1)
    got = {r["episode_id"]: r["fingerprint"] for r in index.indexed(spark, dst, schema).collect()}
    assert got == {1: [9], 2: [3]}
