"""Documents that share most of a text but not enough of it: what links is found, and the others don't meet in pairs."""

import numpy as np
import pytest

from reprise.llm import parity_join

from .test_operators import _sets

GROUP = 80


@pytest.fixture
def tried(monkeypatch):
    """How many pairs each round hands on."""
    counts, plausible = [], parity_join._plausible
    monkeypatch.setattr(parity_join, "_plausible", lambda pairs, nodes: counts.append(pairs.count()) or plausible(pairs, nodes))
    return counts


def _sharing():
    """A passage of 240 words in each document, 60 words of its own after it: the similarity of any two is 0.66."""
    passage = " ".join(f"p{x}" for x in range(240))
    return [(i, passage + " " + " ".join(f"q{i}x{x}" for x in range(60))) for i in range(GROUP)]


def _expected(rows):
    sets = _sets(rows)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def _got(spark, rows):
    return {r[0]: (r[1], r[2]) for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_shared_passage_makes_no_pairs(spark, tried):
    rows = _sharing()
    assert _got(spark, rows) == {i: (296, i) for i, _ in rows}
    assert sum(tried[1:]) <= GROUP  # of 3,160 pairs


def test_links_about_the_threshold(spark):
    rng, rows = np.random.default_rng(8), []
    for family in range(8):
        size = int(rng.choice([12, 30, 70, 150, 320]))
        base = [f"f{family % 5}w{x}" for x in range(size)]  # families of one name share their beginnings
        for _ in range(30):
            w = list(base[: size - int(rng.integers(0, size // 4 + 1))])
            for p in rng.integers(0, len(w), int(rng.integers(0, 1 + max(1, len(w) // 24)))):
                w[p] = f"v{rng.integers(0, 40 if family % 2 else 10**9)}"
            w += [f"z{rng.integers(0, 10**9)}" for _ in range(int(rng.integers(0, size // 5 + 1)))]
            rows.append((len(rows), " ".join(w)))
    want = _expected(rows)
    assert 20 < len({c for _, c in want.values()}) < len(rows) - 20
    assert _got(spark, rows) == want
