"""Votes of pieces against votes of all pairs of frames, plainly counted."""

import random
from collections import Counter, defaultdict

import pytest

from reprise.operators import diagonals, sequence


def plain_runs(hit, bridge, floor):
    out = []
    for e in sorted({e for e, _ in hit}):
        run = []
        for f in [*sorted(f for x, f in hit if x == e), None]:
            if run and (f is None or f - run[-1] > bridge + 1):
                if run[-1] - run[0] + 1 >= floor:
                    out.append((e, run[0], run[-1], len(run)))
                run = []
            run.append(f)
    return out


def plain_hits(query, library, least, apart):
    by, votes = defaultdict(list), Counter()
    for other, o, g, v in library:
        by[v].append((other, o, g))
    pairs = [(e, f, other, g) for e, f, v in query for other, o, g in by[v] if apart(e, o)]
    for e, f, other, g in pairs:
        votes[e, other, f - g] += 1
    return {(e, f) for e, f, other, g in pairs if votes[e, other, f - g] >= least}, {(e, other, f - g, f) for e, f, other, g in pairs if votes[e, other, f - g] >= least}


@pytest.fixture(scope="module")
def corpus():
    """Episodes of shared lines, runs of one value of any length, and values of their own; two copies, and an id that comes twice."""
    draw = random.Random(3)
    lines = [[100 * i + j for j in range(draw.randint(1, 7))] for i in range(8)] + [[900, 901, 900, 901, 900]]
    seqs = []
    for e in range(16):
        seq = []
        while len(seq) < 45:
            kind = draw.random()
            seq += lines[0] if kind < 0.25 else draw.choice(lines) if kind < 0.6 else [draw.choice([7, 8])] * draw.randint(1, 14) if kind < 0.85 else [draw.randrange(5000, 5060)]
        seqs.append((e, seq))
    seqs += [(16, seqs[2][1]), (17, seqs[2][1])]
    return seqs, draw


@pytest.mark.parametrize("twice", [False, True])
def test_regions_from_pieces(spark, corpus, twice, monkeypatch):
    monkeypatch.setattr(diagonals, "COMMON", 3)
    seqs, draw = corpus
    seqs = seqs + [(3, seqs[5][1]), (4, seqs[4][1])] * twice
    query = [(e, f, v) for e, seq in seqs for f, v in enumerate(seq)]
    library = []
    for ad in range(24):
        e, seq = seqs[draw.randrange(len(seqs))]
        at = draw.randrange(len(seq))
        library += [(ad, e if ad % 5 else -1 - ad, j, v) for j, v in enumerate(seq[at : at + draw.randint(3, 25)]) if draw.random() < 0.97]
    q = spark.createDataFrame(query, "episode_id long, frame int, value long")
    lib = spark.createDataFrame(library, "ad_id long, episode_id long, frame int, value long")
    got = sequence.match_regions(q, lib, None, 8, 8, 1)
    want = plain_runs(plain_hits(query, library, 8, lambda e, o: e != o)[0], 1, 8)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 9


def test_recurrence_from_pieces_a_slice_at_a_time(spark, corpus, monkeypatch):
    monkeypatch.setattr(diagonals, "COMMON", 3)
    monkeypatch.setattr(diagonals, "PAIRS_A_SLICE", 1500)
    slices, whole = [], diagonals._slice
    monkeypatch.setattr(diagonals, "_slice", lambda *a: (slices.append(1), whole(*a))[1])
    seqs, _ = corpus
    query = [(e, f, v) for e, seq in seqs for f, v in enumerate(seq)]
    got = sequence.discover_recurring(spark.createDataFrame(query, "episode_id long, frame int, value long"), 1.0, 8, match_frames=9, floor=9, bridge=1)
    hit, _ = plain_hits(query, [(e, e, f, v) for e, f, v in query], 9, lambda e, o: e != o)
    want = plain_runs(hit, 1, 9)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 9 and len(slices) > 1


def test_long_runs_of_one_value_do_not_meet_frame_by_frame(spark):
    """30,000 times 40,000 equal frames: 1.2 billion pairs, two pieces."""
    run = lambda e, n: spark.range(n).selectExpr(f"{e}L AS episode_id", "cast(id AS int) AS frame", "5L AS value")
    got = sequence.match_regions(run(1, 30_000), run(2, 40_000).selectExpr("9L AS ad_id", "*"), None, 20, 20)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 29_999, 30_000)]
