"""One plan over all episodes says what a library without each of them would, one after the other."""

import random

from pyspark.sql import functions as F

from reprise.operators import sequence, text, tiers


def episodes_of_text(draw):
    ads = [" ".join(f"{a}{draw.randint(0, 5)}" for a in "vwxyz" for _ in range(2)) for _ in range(4)]
    segments, spans = [], []
    for e in range(8):
        for i in range(12):
            said = draw.choice([*ads, " ".join(draw.choices("abcdefgh", k=9)), "too short"])
            segments.append((e, i, float(i), i + 1.0, said))
            if draw.random() < 0.3:
                spans.append((len(spans), e, float(i), i + 0.5, draw.choice(["chapter", "llm", "manual", "repeat", "dai"])))
    return segments, spans


def test_text_held_out(spark):
    segments, spans = episodes_of_text(random.Random(3))
    segments = spark.createDataFrame(segments, "episode_id long, seg_idx int, start double, end double, text string")
    spans = spark.createDataFrame(spans, "id long, episode_id long, start double, end double, source string")
    runs = {tuple(r) for r in text.held_out_runs(segments, spans).select("episode_id", "first", "last").collect()}
    single = set()
    for e in (1, 2, 6):
        own = segments.where(F.col("episode_id") == e)
        single |= {tuple(r) for r in text.repeat_detect(own, text.text_library(segments, spans, exclude=e)).select("episode_id", "first", "last").collect()}
    assert {r for r in runs if r[0] in (1, 2, 6)} == single and single
    recall = {r["episode_id"]: r for r in text.text_recall(segments, spans).collect()}
    truth = {(s[0], s[1]) for s in text.covered_segments(segments, spans.where("source in ('chapter', 'llm', 'manual')")).collect()}
    for e, r in recall.items():
        mine = {x for x in truth if x[0] == e}
        found = {x for x in mine if any(a == e and f <= x[1] <= last for a, f, last in runs)}
        assert (r["truth"], r["found"]) == (len(mine), len(found))
    assert recall.keys() == {e for e, _ in truth}


def sequences(draw, episodes=7):
    bed, ads = [900 + i for i in range(4)], [[draw.randint(0, 300) for _ in range(8)] for _ in range(5)]
    frames, spans = [], []
    for e in range(episodes):
        values = []
        for _ in range(9):
            at = len(values)
            part = draw.choice([*ads, bed + [draw.randint(0, 300) for _ in range(6)], bed])
            values += part
            if part in ads and draw.random() < 0.6 and e != 3:
                spans.append((len(spans), e, 2.0 * at, 2.0 * (at + len(part)), draw.choice(["chapter", "llm", "dai", "fpmatch"])))
        frames += [(e, i, v) for i, v in enumerate(values)]
    return frames, spans


def test_audio_held_out(spark):
    for seed, fraction in ((1, 0.3), (2, 0.5)):
        frames, spans = sequences(random.Random(seed))
        frames = spark.createDataFrame(frames, "episode_id long, frame int, value long")
        spans = spark.createDataFrame(spans, "id long, episode_id long, start double, end double, source string")
        sizes = frames.groupBy("episode_id").agg(F.count("*").alias("frames"), (2.0 * F.count("*")).alias("duration"))
        held = {tuple(r) for r in tiers.held_out_regions(frames, sizes, spans, 4, 4, 1, fraction).collect()}
        single = set()
        some = (0, 3, 5)
        held = {r for r in held if r[0] in some}
        for e in some:
            library, stop = tiers.audio_library(frames, sizes, spans, exclude=e, fraction=fraction)
            single |= {tuple(r) for r in sequence.match_regions(frames.where(F.col("episode_id") == e), library, stop, 4, 4, 1).collect()}
        assert held == single and held


def test_recall_by_span_and_length(spark):
    same = list(range(30))
    frames = [(0, i, v) for i, v in enumerate(same)] + [(1, i + 5, v) for i, v in enumerate(same)] + [(1, i, 500 + i) for i in range(5)] + [(2, i, 700 + i) for i in range(40)]
    frames = spark.createDataFrame(frames, "episode_id long, frame int, value long")
    sizes = frames.groupBy("episode_id").agg(F.count("*").alias("frames"), F.count("*").cast("double").alias("duration"))
    spans = spark.createDataFrame([(0, 0, 0.0, 20.0, "llm"), (1, 1, 0.0, 15.0, "dai"), (2, 2, 3.0, 9.0, "llm"), (3, 2, 3.1, 3.2, "llm"), (4, 0, 0.0, 9.0, "recur")], "id long, episode_id long, start double, end double, source string")
    got = {r["episode_id"]: tuple(r)[1:] for r in tiers.audio_recall(frames, sizes, spans, 5, 5).collect()}
    # episode 1 confirms values 0 to 9, episode 0 values 0 to 19
    assert got == {0: (1, 1, 20, 10), 1: (1, 1, 15, 10), 2: (1, 0, 6, 0)}
    assert tiers.audio_recall(frames, sizes, spans.where("false"), 5, 5).collect() == []
