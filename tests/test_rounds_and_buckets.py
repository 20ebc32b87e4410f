"""Set cover in rounds, joins on time in stretches, chunks as a table function: each against its plain version."""

import random

import pytest
from pyspark.sql import functions as F

from reprise.operators import campaigns, detect, intervals


def one_pick_at_a_time(pairs):
    left, out = set(pairs), []
    while left:
        size = {}
        for _, o in left:
            size[o] = size.get(o, 0) + 1
        top = min(size, key=lambda o: (-size[o], o))
        out.append((top, size[top], len(out)))
        gone = {i for i, o in left if o == top}
        left = {(i, o) for i, o in left if i not in gone}
    return out


@pytest.mark.parametrize("seed, items, owners, many", [(1, 300, 120, 420), (2, 40, 40, 60), (3, 30, 6, 120)])
def test_set_cover_in_rounds_picks_as_one_at_a_time(spark, seed, items, owners, many):
    rng = random.Random(seed)
    pairs = [(rng.randrange(items), rng.randrange(owners)) for _ in range(many)]
    got = campaigns.greedy_set_cover(spark.createDataFrame(pairs + pairs[:9] + [(None, 1), (2, None)], "item long, owner long"))
    assert sorted((r["owner"], r["covers"], r["rank"]) for r in got.collect()) == sorted(one_pick_at_a_time(pairs))


def test_set_cover_that_waits_in_a_chain_joins_its_picks(spark, monkeypatch):
    monkeypatch.setattr(campaigns, "PICKS_AT_ONCE", 2)
    pairs = [(f"{o}-{j}", o) for o in range(6) for j in range(9 - o)] + [(f"{o}-0", o + 1) for o in range(5)]
    got = campaigns.greedy_set_cover(spark.createDataFrame(pairs, "item string, owner long"))
    assert [(r["owner"], r["covers"], r["rank"]) for r in got.orderBy("rank").collect()] == one_pick_at_a_time(pairs)


def test_set_cover_of_nothing(spark):
    got = campaigns.greedy_set_cover(spark.createDataFrame([], "item long, owner long"))
    assert got.columns == ["owner", "covers", "rank"] and got.count() == 0


@pytest.fixture(scope="module")
def timelines():
    rng = random.Random(4)
    cut = lambda n, longest: [(rng.randrange(3), x := rng.randrange(0, 4000) / 4, x + rng.randrange(0, longest) / 4) for _ in range(n)]
    # edges on the borders of stretches, repeats, an empty one, one over many stretches, one turned round, nulls
    segments = cut(300, 90) + [(0, 60.0, 120.0)] * 2 + [(0, 120.0, 120.0), (1, 10.0, 900.0), (9, 1.0, 2.0), (0, None, 5.0), (0, 5.0, None)]
    return segments, cut(40, 1200) + [(0, 120.0, 130.0), (0, 59.0, 60.0), (1, 300.0, 200.0), (2, None, 4.0), (2, 3.0, None), (None, 1.0, 9.0)]


def test_covered_segments_in_stretches(spark, timelines):
    segments, spans = (spark.createDataFrame(x, "episode_id long, start double, end double") for x in timelines)
    over = lambda a, b: a[0] == b[0] and None not in (*a, *b) and a[2] > b[1] and a[1] < b[2]
    got = intervals.covered_segments(segments.withColumn("_b", F.lit(1)), spans)
    assert got.columns == ["episode_id", "start", "end", "_b"]
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(a for a in timelines[0] if any(over(a, b) for b in timelines[1]))


def test_speech_filter_in_stretches(spark, timelines):
    spans = spark.createDataFrame([(*x, "fp") for x in timelines[0]], "episode_id long, start double, end double, source string")
    words = [(*x, "one  two " * (i % 3)) for i, x in enumerate(timelines[1])]
    segments = spark.createDataFrame(words, "episode_id long, start double, end double, text string")
    known = {w[0] for w in words}
    said = lambda a: sum(len(w[3].split()) for w in words if None not in (*a, *w) and a[0] == w[0] and w[2] > a[1] and w[1] < a[2])
    got = sorted(((r["episode_id"], r["start"] or -1, r["end"] or -1) for r in intervals.speech_filter(spans, segments).collect()))
    assert got == sorted((a[0], a[1] or -1, a[2] or -1) for a in timelines[0] if a[0] not in known or said(a) >= 5)


def test_points_in_runs_in_stretches(spark):
    rng = random.Random(6)
    points = [(rng.randrange(2), rng.randrange(3000)) for _ in range(400)] + [(0, 255), (0, 256), (0, None)]
    runs = [(rng.randrange(2), x := rng.randrange(3000), x + rng.randrange(700), i) for i in range(12)] + [(0, 256, 256, 50), (0, 90, 20, 51), (0, None, 3, 52)]
    got = intervals.point_in_run(spark.createDataFrame(points, "e long, at long"), spark.createDataFrame(runs, "e long, first long, last long, run long"), "e", "at")
    want = [(e, p, r) for e, p in points for k, a, b, r in runs if None not in (p, a) and k == e and a <= p <= b]
    assert sorted((x["e"], x["at"], x["run"]) for x in got.collect()) == sorted(want)


def test_snap_in_stretches(spark):
    rng = random.Random(8)
    spans = [(i, i % 2, x := rng.randrange(0, 2000) / 4, x + rng.randrange(1, 600) / 4) for i in range(80)] + [(90, 0, 59.5, 60.5), (91, 1, 60.0, 120.0)]
    quiet = [(rng.randrange(2), x := rng.randrange(0, 2600) / 4, x + 0.5) for _ in range(200)] + [(1, 62.5, 117.5)]
    got = intervals.snap_inward(spark.createDataFrame(spans, "span_id long, e long, start double, end double"), spark.createDataFrame(quiet, "e long, start double, end double"), "e")
    want = set()
    for i, e, a, b in spans:
        edges = [x for k, *q in quiet if k == e for x in q]
        s, t = min([x for x in edges if a <= x <= a + 2.5], default=a), max([x for x in edges if b - 2.5 <= x <= b], default=b)
        want.add((i, *((s, t) if t > s else (a, b))))
    assert {(r["span_id"], r["start"], r["end"]) for r in got.collect()} == want


def packed(lines, budget):
    """(first text, chunks) of one key's (line, skip), plainly."""
    told, gone = [], 0
    for line, skip in [*lines, (None, None)]:
        if skip:
            gone += 1
            continue
        if gone:
            told.append(f"({gone} segment(s) already known)")
            gone = 0
        if skip is not None or line is not None:
            told.append(line or "")
    out = []
    for line in told:
        if out and sum(len(x) + 1 for x in out[-1]) + len(line) + 1 <= budget:
            out[-1].append(line)
        else:
            out.append([line])
    return out


def test_chunks_from_sql_with_keys_of_any_type(spark):
    rng = random.Random(5)
    rows = [(f"e{rng.randrange(4)}", i, "x" * rng.randrange(0, 40), rng.random() < 0.3, "other") for i in range(200)] + [("e7", 1, None, False, "o"), ("e8", 1, "a", True, "o"), ("e9", 2, "y" * 300, False, "o")]
    spark.createDataFrame(rows, "episode_id string, seg_idx long, line string, skip boolean, text string").repartition(3).createOrReplaceTempView("told_lines")
    detect.register_functions(spark)
    got = {(r["episode_id"], r["chunk"]): (r["lines"], r["text"]) for r in spark.sql("SELECT * FROM chunk_lines(TABLE(told_lines), 100)").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, lines in enumerate(packed([(r[2], r[3]) for r in sorted(rows, key=lambda r: r[1]) if r[0] == key], 100)):
            want[key, n] = len(lines), "\n".join(lines)
    assert got == want and got["e8", 0] == (1, "(1 segment(s) already known)")


@pytest.mark.parametrize("call", ["chunk_lines(TABLE(SELECT 1 AS episode_id), 100)", "chunk_lines(TABLE(told_lines), 0)"])
def test_chunks_refuse_what_they_cannot_use(spark, call):
    detect.register_functions(spark)
    spark.createDataFrame([], "episode_id string, seg_idx long, line string, skip boolean").createOrReplaceTempView("told_lines")
    with pytest.raises(Exception, match="lack|budget"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_a_long_episode_comes_out_whole(spark):
    """300,000 lines of one key come out in chunks; that only one of them is held at a time is how ChunkLines is made."""
    lines = spark.range(300_000).select(F.lit(1).alias("episode_id"), F.col("id").alias("seg_idx"), F.format_string("%0100d", "id").alias("line"), F.lit(False).alias("skip"))
    got = detect.ChunkLines(lines.asTable(), F.lit(20_000)).select(F.count("*").alias("n"), F.sum("lines").alias("lines"), F.max(F.length("text")).alias("longest"))
    row = got.collect()[0]
    assert row["lines"] == 300_000 and row["n"] == -(-300_000 // (20_000 // 101)) and row["longest"] <= 20_000
