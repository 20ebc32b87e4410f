"""One id on several texts, and the choice of one document of each group."""

import corpus_pipeline
from reprise.llm import parity_join


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_an_id_with_two_texts_links_through_both(spark):
    a, b = words(0, 60), words(100, 160)
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, words(200, 260)), (9, words(200, 260) + " z"), (9, "short"), (4, "short"), (None, a), (11, None), (11, words(300, 340))]
    got = [tuple(r) for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 56, 5), (5, 56, 5), (6, 57, 5), (7, 57, 5), (8, 56, 4), (9, 57, 4), (9, 1, 4), (4, 1, 4), (None, 56, 5), (11, 0, 11), (11, 36, 11)], key=str)


def test_copies_in_many_tasks_post_once(spark):
    rows = [(i, words(0, 60)) for i in range(40)] + [(100 + i, words(0, 60) + f" t{i}") for i in range(5)] + [(200, words(500, 560))]
    got = {r["doc_id"]: r["component_id"] for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()}
    assert got == {i: 0 for i, _ in rows if i < 200} | {200: 200}


def test_one_of_each_group_keeps_one_row(spark):
    a = words(0, 60)
    rows = [(1, a, "p"), (1, a, "q"), (1, a, "q"), (2, a + " x", "p"), (3, None, None), (3, None, None), (4, "", "p"), (None, a, "p"), (None, a, "p"), (6, words(100, 160), "s"), (6, words(300, 360), "s")]
    docs = spark.createDataFrame([(*r, "1", 2) for r in rows], "doc_id long, text string, source string, row string, h int")
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted((tuple(r)[:2] for r in got.collect()), key=str)
    assert left == sorted([(1, a), (3, None), (4, ""), (None, a), (None, a), (6, rows[9][1]), (6, rows[10][1])], key=str)
