"""Queries that take whole tables, against plain loops on small fixtures."""

from datetime import datetime

import pytest

from reprise.plans import catalog
from reprise.plans import views as V


def _table(spark, sf, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Orders that join customers and parts in two components, long and short documents, events beyond 997."""
    d = str(tmp_path_factory.mktemp("sf"))
    _table(spark, d, "orders", [(i, i % 4 if i < 20 else 50 + i % 3) for i in range(1, 40)], "o_orderkey long, o_custkey long")
    _table(spark, d, "lineitem", [(i, (i * n) % 6 if i < 20 else 90 + n, n) for i in range(1, 40) for n in (1, 2)], "l_orderkey long, l_partkey long, l_linenumber int")
    line = lambda i, j: f"d{i} l{j}" if i % 4 else f"one two three four five six {i} {j}"
    docs = [(i, "\n".join(line(i, j) for j in range(400 if i % 50 == 0 else 3)), "en", f"src{i % 3}") for i in range(1500)]
    _table(spark, d, "documents", [(*r, len(r[1])) for r in docs], "doc_id long, text string, lang string, source string, n_chars long")
    _table(spark, d, "labels", [(i, 1, 0) for i in range(0, 1500, 2)], "doc_id long, quality int, toxic int")
    _table(spark, d, "events", [(i, datetime(2026, 1, 1), i % 7, f"e{i % 5}", 1.0) for i in range(6000)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    return d


def _run(spark, sf, name):
    return [tuple(r) for r in catalog.queries()[name](spark, sf).collect()]


def _lines(spark, sf):
    """(episode, index, start, end, text) of each line, 16 characters a second."""
    out = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        at, out[r["doc_id"]] = 0, []
        for j, x in enumerate(r["text"].split("\n")):
            out[r["doc_id"]].append((j, at / 16, (at + len(x) + 1) / 16, x))
            at += len(x) + 1
    return out


def test_components_of_all_edges(spark, sf):
    edges = [(r["o_custkey"], r["o_orderkey"] + 10**9) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()]
    edges += [(r["l_partkey"] + 2 * 10**9, r["l_orderkey"] + 10**9) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()]
    want = {x: x for e in edges for x in e}
    while any(want[a] != want[b] for a, b in edges):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert sorted(_run(spark, sf, "connected_components")) == sorted(want.items()) and len(set(want.values())) > 1


def test_speech_of_all_lines(spark, sf):
    lines = _lines(spark, sf)
    words = lambda s: sum(len(x.split()) for _, a, b, x in lines.get(s["episode_id"], []) if b > s["start"] and a < s["end"])
    want = [(s["id"], s["episode_id"]) for s in V.spans(spark, sf).collect() if s["episode_id"] % 3 == 0 or words(s) >= 5]
    assert sorted(_run(spark, sf, "speech_filter")) == sorted(want) and len(want) < 6000


def test_passages_of_many_documents_recur(spark, tmp_path):
    """A passage in a fifth of the documents lies between a stop fraction of 0.05 and the library's 0.30."""
    passage = " ".join(f"p{k}" for k in range(120))
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30)) + (f" {passage}" if i % 5 == 0 else "")
    _table(spark, tmp_path, "documents", [(i, text(i)) for i in range(60)], "doc_id long, text string")
    _table(spark, tmp_path, "benchmark", [(0, "none of these words is in a document")], "item_id long, text string")
    assert sorted(r[0] for r in _run(spark, tmp_path, "discover_recurring")) == list(range(0, 60, 5))
    assert [r["reach"] for r in catalog.queries()["find_campaigns"](spark, str(tmp_path)).collect()] == [12]
    assert _run(spark, tmp_path, "select_seed_episodes") == [(0, 1, 0)]


def test_bytes_beyond_16_kib(spark, tmp_path):
    head, tail = "h" * 20_000, "".join(f"t{k} " for k in range(2_000))
    _table(spark, tmp_path, "documents", [(0, head + "a" * 40 + tail), (1, head + "b" * 7_000 + tail)], "doc_id long, text string")
    assert _run(spark, tmp_path, "dai_tier") == [(0, 20_000 / 16 + 2, 20_000 / 16 + 2 + 240, 0.5, None)]


def test_spans_over_all_documents(spark, sf):
    lines, spans = _lines(spark, sf), V.spans(spark, sf).collect()
    assert len(spans) == 6000 and {s["episode_id"] for s in spans} == set(range(1500))
    assert max(s["start"] for s in spans) > 125 and all(s["start"] < lines[s["episode_id"]][-1][2] for s in spans)
    over = [(s["episode_id"], j, s["id"], s["source"]) for s in spans for j, a, b, _ in lines[s["episode_id"]] if b > s["start"] and a < s["end"]]
    assert sorted(_run(spark, sf, "overlap_join")) == sorted(over)
    assert sorted(_run(spark, sf, "covered_segments")) == sorted({x[:2] for x in over})
    truth = {(i, j) for i, j, _, source in over if source in ("chapter", "llm", "manual")}
    grams = {" ".join(w[k : k + 5]) for i, j in truth for w in [lines[i][j][3].split()] for k in range(len(w) - 4)}
    assert {r[0] for r in _run(spark, sf, "text_library")} == grams
    counts = {i: sum(s["episode_id"] == i and s["source"] in ("chapter", "llm", "manual") for s in spans) for i in range(0, 1500, 2)}
    assert {r[0]: r[2] for r in _run(spark, sf, "truth_counts")} == counts
    cut = {s["episode_id"] for s in spans if s["source"] in ("chapter", "llm", "manual", "repeat", "fpmatch")}
    assert sorted(r[0] for r in _run(spark, sf, "pending_cut")) == sorted(i for i in cut if i % 13 and i % 17)
    assert len(_run(spark, sf, "snap_inward")) == sum(s["source"] in ("chapter", "llm", "manual", "repeat", "fpmatch") for s in spans)
    found = _run(spark, sf, "span_grounding")
    assert max(r[0] for r in found) >= 997 and max(r[1] for r in found) > 125
    assert any("already known" in r[3] for r in _run(spark, sf, "greedy_chunks") if r[0] >= 997)
